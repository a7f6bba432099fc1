"""Spark jobs that turn prose manuscripts into timed storyboards."""
