"""Signature rules of the license scan, in order: label, priority, keywords, pattern.

Patterns are written for texts as the scan reads them: words of lower-case letters and digits with one space between. {v} stands for
the ways to say that a version follows, {l} for license and its other spelling, {any} for up to three words. A rule is tried only where one of
its keywords is a word of the text; every match holds one of them. Of two rules at one place the one of higher priority counts:

5  identifiers that are made to be read by machines
4  names with a version, and addresses of license texts
3  sentences that only one license (or family) has
2  names without a version, and words of a grant
1  what only says that somebody keeps or gives up rights
"""

RULES = r"""
gpl-1.0 | 5 | spdx | spdx {l} identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 5 | spdx | spdx {l} identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 5 | spdx | spdx {l} identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | 5 | spdx | spdx {l} identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 5 | spdx | spdx {l} identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 5 | spdx | spdx {l} identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 5 | spdx | spdx {l} identifier agpl 3 0(?: only| or later)?
apache-1.1 | 5 | spdx | spdx {l} identifier apache 1 1
apache-2.0 | 5 | spdx | spdx {l} identifier apache 2 0
mit | 5 | spdx | spdx {l} identifier mit
mit-0 | 5 | spdx | spdx {l} identifier mit 0
bsd-2-clause | 5 | spdx | spdx {l} identifier bsd 2 clause
bsd-3-clause | 5 | spdx | spdx {l} identifier bsd 3 clause
bsd-4-clause | 5 | spdx | spdx {l} identifier bsd 4 clause
0bsd | 5 | spdx | spdx {l} identifier 0bsd
isc | 5 | spdx | spdx {l} identifier isc
zlib | 5 | spdx | spdx {l} identifier zlib
mpl-1.1 | 5 | spdx | spdx {l} identifier mpl 1 1
mpl-2.0 | 5 | spdx | spdx {l} identifier mpl 2 0
epl-1.0 | 5 | spdx | spdx {l} identifier epl 1 0
epl-2.0 | 5 | spdx | spdx {l} identifier epl 2 0
cddl-1.0 | 5 | spdx | spdx {l} identifier cddl 1 0
bsl-1.0 | 5 | spdx | spdx {l} identifier bsl 1 0
unlicense | 5 | spdx | spdx {l} identifier unlicense
wtfpl | 5 | spdx | spdx {l} identifier wtfpl
cc0-1.0 | 5 | spdx | spdx {l} identifier cc0 1 0
cc-by-3.0 | 5 | spdx | spdx {l} identifier cc by 3 0
cc-by-4.0 | 5 | spdx | spdx {l} identifier cc by 4 0
cc-by-sa-3.0 | 5 | spdx | spdx {l} identifier cc by sa 3 0
cc-by-sa-4.0 | 5 | spdx | spdx {l} identifier cc by sa 4 0
cc-by-nc-4.0 | 5 | spdx | spdx {l} identifier cc by nc 4 0
artistic-2.0 | 5 | spdx | spdx {l} identifier artistic 2 0
eupl-1.2 | 5 | spdx | spdx {l} identifier eupl 1 2
ofl-1.1 | 5 | spdx | spdx {l} identifier ofl 1 1
postgresql | 5 | spdx | spdx {l} identifier postgresql
python-2.0 | 5 | spdx | spdx {l} identifier (?:psf|python) 2 0
ncsa | 5 | spdx | spdx {l} identifier ncsa
unknown-spdx | 4 | spdx | spdx {l} identifier [^ ]+
gpl-1.0 | 4 | general | (?:gnu )?general public {l}{v} 1(?: 0)?
gpl-2.0 | 4 | general | (?:gnu )?general public {l}{v} 2(?: 0)?
gpl-2.0-or-later | 4 | general | (?:gnu )?general public {l}{any} either version 2 of the {l} or at your option any later version
gpl-3.0 | 4 | general | (?:gnu )?general public {l}{v} 3(?: 0)?
gpl-3.0-or-later | 4 | general | (?:gnu )?general public {l}{any} either version 3 of the {l} or at your option any later version
gpl-2.0 | 4 | gplv2 gpl2 | (?:gnu )?(?:gplv2|gpl2)
gpl-3.0 | 4 | gplv3 gpl3 | (?:gnu )?(?:gplv3|gpl3)
gpl-2.0 | 4 | gpl | (?:gnu )?gpl{v} 2(?: 0)?
gpl-3.0 | 4 | gpl | (?:gnu )?gpl{v} 3(?: 0)?
gpl-2.0 | 4 | gnu | www gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
gpl-3.0 | 4 | gnu | www gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-3.0 | 4 | gnu | www gnu org licenses gpl (?:html|txt)
lgpl-2.0 | 4 | library | (?:gnu )?library general public {l}{v} 2(?: 0)?
lgpl-2.1 | 4 | lesser | (?:gnu )?lesser general public {l}{v} 2 1
lgpl-3.0 | 4 | lesser | (?:gnu )?lesser general public {l}{v} 3(?: 0)?
lgpl-2.1 | 4 | lgpl | (?:gnu )?lgpl{v} 2 1
lgpl-3.0 | 4 | lgpl | (?:gnu )?lgpl{v} 3(?: 0)?
lgpl-2.1 | 4 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | 4 | lgplv3 | (?:gnu )?lgplv3
agpl-3.0 | 4 | affero | (?:gnu )?affero general public {l}{v} 3(?: 0)?
agpl-1.0 | 4 | affero | affero general public {l}{v} 1(?: 0)?
agpl-3.0 | 4 | agplv3 | (?:gnu )?agplv3
agpl-3.0 | 4 | agpl | (?:gnu )?agpl{v} 3(?: 0)?
gfdl-1.2 | 4 | documentation | (?:gnu )?free documentation {l}{v} 1 2
gfdl-1.3 | 4 | documentation | (?:gnu )?free documentation {l}{v} 1 3
apache-1.0 | 4 | apache | apache (?:software )?{l}{v} 1 0
apache-1.1 | 4 | apache | apache (?:software )?{l}{v} 1 1
apache-2.0 | 4 | apache | apache (?:software )?{l}{v} 2(?: 0)?
apache-2.0 | 4 | apache | apache 2(?: 0)? {l}
apache-2.0 | 4 | apache | apache org licenses {l} 2 0(?: html| txt)?
apache-2.0 | 4 | apache2 | apache2(?: {l})?
mpl-1.0 | 4 | mozilla | mozilla public {l}{v} 1 0
mpl-1.1 | 4 | mozilla | mozilla public {l}{v} 1 1
mpl-2.0 | 4 | mozilla | mozilla public {l}{v} 2 0
mpl-2.0 | 4 | mozilla | mozilla org mpl 2 0
mpl-1.1 | 4 | mpl | mpl{v} 1 1
mpl-2.0 | 4 | mpl | mpl{v} 2(?: 0)?
epl-1.0 | 4 | eclipse | eclipse public {l}{v} 1 0
epl-2.0 | 4 | eclipse | eclipse public {l}{v} 2 0
epl-2.0 | 4 | eclipse | eclipse org legal epl 2 0
cpl-1.0 | 4 | common | common public {l}{v} 1 0
cddl-1.0 | 4 | common | common development and distribution {l}{v} 1 0
cddl-1.1 | 4 | common | common development and distribution {l}{v} 1 1
cpal-1.0 | 4 | common | common public attribution {l}{v} 1 0
eupl-1.1 | 4 | european | european union public {l}{v} 1 1
eupl-1.2 | 4 | european | european union public {l}{v} 1 2
osl-3.0 | 4 | open | open software {l}{v} 3 0
afl-3.0 | 4 | academic | academic free {l}{v} 3 0
afl-2.1 | 4 | academic | academic free {l}{v} 2 1
bsl-1.0 | 4 | boost | boost software {l}{v} 1 0
bsl-1.0 | 4 | boost | boost org {l} 1 0(?: txt)?
artistic-1.0 | 4 | artistic | artistic {l}{v} 1 0
artistic-2.0 | 4 | artistic | artistic {l}{v} 2 0
ofl-1.0 | 4 | sil | sil open font {l}{v} 1 0
ofl-1.1 | 4 | sil | sil open font {l}{v} 1 1
ofl-1.1 | 4 | ofl | scripts sil org ofl
zpl-2.1 | 4 | zope | zope public {l}{v} 2 1
ecl-2.0 | 4 | educational | educational community {l}{v} 2 0
upl-1.0 | 4 | universal | universal permissive {l}{v} 1 0
ms-pl | 4 | microsoft | microsoft public {l}(?: ms pl)?
ms-rl | 4 | microsoft | microsoft reciprocal {l}(?: ms rl)?
mulan-2.0 | 4 | mulan | mulan (?:psl|permissive software {l}){v} 2
cecill-2.1 | 4 | cecill | cecill(?: free software {l}(?: agreement)?)?{v} 2 1
odbl-1.0 | 4 | odbl open | (?:odbl|open database {l}(?: odbl)?){v} 1 0
odc-by-1.0 | 4 | attribution | open data commons attribution {l}{v} 1 0
pddl-1.0 | 4 | dedication | open data commons public domain dedication and {l}{v} 1 0
cc-by-1.0 | 4 | attribution | (?:creative commons )?attribution 1 0(?: generic)?(?: {l})?
cc-by-2.0 | 4 | attribution | (?:creative commons )?attribution 2 0(?: generic)?(?: {l})?
cc-by-2.5 | 4 | attribution | (?:creative commons )?attribution 2 5(?: generic)?(?: {l})?
cc-by-3.0 | 4 | attribution | (?:creative commons )?attribution 3 0(?: unported)?(?: {l})?
cc-by-4.0 | 4 | attribution | (?:creative commons )?attribution 4 0(?: international)?(?: public)?(?: {l})?
cc-by-sa-2.0 | 4 | sharealike | (?:creative commons )?attribution sharealike 2 0(?: generic)?(?: {l})?
cc-by-sa-3.0 | 4 | sharealike | (?:creative commons )?attribution sharealike 3 0(?: unported)?(?: {l})?
cc-by-sa-4.0 | 4 | sharealike | (?:creative commons )?attribution sharealike 4 0(?: international)?(?: public)?(?: {l})?
cc-by-nc-3.0 | 4 | noncommercial | (?:creative commons )?attribution noncommercial 3 0(?: unported)?(?: {l})?
cc-by-nc-4.0 | 4 | noncommercial | (?:creative commons )?attribution noncommercial 4 0(?: international)?(?: {l})?
cc-by-nc-sa-3.0 | 4 | noncommercial | (?:creative commons )?attribution noncommercial sharealike 3 0(?: unported)?(?: {l})?
cc-by-nc-sa-4.0 | 4 | noncommercial | (?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?(?: {l})?
cc-by-nc-nd-4.0 | 4 | noderivatives | (?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?(?: {l})?
cc-by-nd-4.0 | 4 | noderivatives | (?:creative commons )?attribution noderivatives 4 0(?: international)?(?: {l})?
cc-by-1.0 | 4 | cc | cc by 1 0
cc-by-2.0 | 4 | cc | cc by 2 0
cc-by-2.5 | 4 | cc | cc by 2 5
cc-by-3.0 | 4 | cc | cc by 3 0
cc-by-4.0 | 4 | cc | cc by 4 0
cc-by-sa-2.5 | 4 | cc | cc by sa 2 5
cc-by-sa-3.0 | 4 | cc | cc by sa 3 0
cc-by-sa-4.0 | 4 | cc | cc by sa 4 0
cc-by-nc-3.0 | 4 | cc | cc by nc 3 0
cc-by-nc-4.0 | 4 | cc | cc by nc 4 0
cc-by-nd-4.0 | 4 | cc | cc by nd 4 0
cc-by-nc-sa-3.0 | 4 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 4 | cc | cc by nc sa 4 0
cc-by-nc-nd-3.0 | 4 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 4 | cc | cc by nc nd 4 0
cc-by-3.0 | 4 | creativecommons | creativecommons org licenses by 3 0
cc-by-4.0 | 4 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-3.0 | 4 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | 4 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | 4 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 4 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | 4 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 4 | creativecommons | creativecommons org publicdomain mark 1 0
cc0-1.0 | 4 | cc0 | cc0(?: 1 0)?(?: universal)?
bsd-1-clause | 4 | bsd | (?:1|one) clause bsd(?: {l})?
bsd-2-clause | 4 | bsd | (?:2|two) clause bsd(?: {l})?
bsd-3-clause | 4 | bsd | (?:3|three) clause bsd(?: {l})?
bsd-4-clause | 4 | bsd | (?:4|four) clause bsd(?: {l})?
bsd-2-clause | 4 | bsd | bsd (?:2|two) clause(?: {l})?
bsd-3-clause | 4 | bsd | bsd (?:3|three) clause(?: {l})?
bsd-4-clause | 4 | bsd | bsd (?:4|four) clause(?: {l})?
bsd-2-clause | 4 | simplified | simplified bsd {l}
bsd-3-clause | 4 | modified new revised | (?:modified|new|revised) bsd {l}
mit | 4 | opensource | opensource org licenses? mit(?: {l})?(?: php| html)?
bsd-2-clause | 4 | opensource | opensource org licenses? bsd 2 clause
bsd-3-clause | 4 | opensource | opensource org licenses? bsd 3 clause
isc | 4 | opensource | opensource org licenses? isc
zlib | 4 | opensource | opensource org licenses? zlib
mit | 3 | deal | permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ ]+){0,20} to deal in the software without restriction
mit | 3 | sublicense | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 3 | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 3 | holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | 3 | persons | to permit persons to whom the software is furnished to do so the software is provided as is
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 3 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 3 | endorse | neither the names? of{any} nor the names of (?:its|the|any)? ?contributors may be used to endorse or promote products
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 3 | implied | this software is provided by the (?:copyright holders?|authors?|regents)(?: and contributors)? as is and any express(?:ed)? or implied warranties
apache-2.0 | 3 | apache | licensed under the apache {l}(?: [^ ]+){0,6} you may not use this file except in compliance with the {l}
apache-2.0 | 3 | basis | distributed under the {l} is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | 3 | irrevocable | perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) {l}
apache-1.1 | 3 | apache | this product includes software developed by the apache (?:software foundation|group)
gpl | 3 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public {l}
gpl | 3 | hope | this program is distributed in the hope that it will be useful but without any warranty
gpl | 3 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public {l}
gpl | 3 | received | you should have received a copy of the gnu general public {l} along with this program
lgpl | 3 | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {l}
lgpl | 3 | received | you should have received a copy of the gnu (?:lesser|library) general public {l}
agpl | 3 | received | you should have received a copy of the gnu affero general public {l}
agpl | 3 | remotely | users interacting with it remotely through a computer network
gpl | 3 | verbatim | everyone is permitted to copy and distribute verbatim copies of this {l} document but changing it is not allowed
gfdl | 3 | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | 3 | mozilla | this source code form is subject to the terms of the mozilla public {l}
mpl-1.1 | 3 | mozilla | the contents of this file are subject to the mozilla public {l}
epl | 3 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {l}
cddl | 3 | development | the contents of this file are subject to the terms of the common development and distribution {l}
bsl-1.0 | 3 | boost | distributed under the boost software {l}
zlib | 3 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 3 | altered | altered source versions must be plainly marked as such and must not be misrepresented
zlib | 3 | held | in no event will the authors be held liable for any damages arising from the use of this software
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | compile | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 3 | want | you just do what the (?:fuck|f [^ ]+) you want to
beerware | 3 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer(?: in return)?
json | 3 | evil | the software shall be used for good not evil
openssl | 3 | openssl | this product includes software developed by the openssl project
openssl | 3 | cryptographic | this product includes cryptographic software written by eric young
artistic | 3 | verbatim | you may make and give away verbatim copies of the (?:source form|standard version|package)
postgresql | 3 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | 3 | permission | permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose is hereby granted without fee
ncsa | 3 | university | developed by(?: [^ ]+){0,12} permission is hereby granted(?: [^ ]+){0,30} university of illinois ncsa
ofl | 3 | reserved | with reserved font name
ofl | 3 | sil | this font software is licensed under the sil open font {l}
python | 3 | psf | psf is making python available to licensee on an as is basis
cc-by-sa | 3 | similar | you may distribute the resulting work only under the same or similar {l} to this one
cc | 3 | creative | this work is licensed under (?:a|the) creative commons(?: [^ ]+){0,6} {l}
cc | 3 | creativecommons | to view a copy of this {l} visit(?: https?)?(?: www)? creativecommons org
cc0 | 3 | waived | has waived all copyright and related or neighboring rights
epl | 3 | eclipse | available under the terms of the eclipse public {l}
commercial-use-banned | 3 | commercial noncommercial | (?:non commercial|noncommercial) (?:use|purposes) only
no-redistribution | 3 | redistribution redistributed | (?:no redistribution|may not be redistributed|must not be redistributed)
confidential | 3 | confidential | (?:proprietary and confidential|confidential and proprietary)
unauthorized-copying-banned | 3 | unauthorized unauthorised | unauthori[sz]ed (?:copying|reproduction|use|distribution) of this [^ ]+(?: [^ ]+){0,6} is (?:strictly )?prohibited
no-ai-training | 3 | train training | (?:not|never) be used (?:to train|for the training of|for training)(?: [^ ]+){0,3} (?:ai|models?|systems?)
lgpl | 2 | lesser library | (?:gnu )?(?:lesser|library) general public {l}
lgpl | 2 | lgpl | (?:gnu )?lgpl
agpl | 2 | affero agpl | (?:gnu )?(?:affero general public {l}|agpl)
gpl | 2 | gnu | gnu general public {l}
gpl | 2 | gpl | (?:gnu )?gpl
gfdl | 2 | documentation gfdl | (?:gnu )?(?:free documentation {l}|gfdl)
apache | 2 | apache | apache (?:software )?{l}
mit | 2 | mit | (?:the )?mit (?:style |x11 )?{l}
mit | 2 | mit | (?:released|licensed|distributed|available) under (?:the )?mit
mit | 2 | expat x11 | (?:expat|x11) {l}
bsd | 2 | bsd | (?:the )?bsd(?: style)? {l}
isc | 2 | isc | (?:the )?isc {l}
zlib | 2 | zlib | zlib(?: libpng)? {l}
mpl | 2 | mozilla | mozilla public {l}
epl | 2 | eclipse | eclipse public {l}
cddl | 2 | cddl distribution | (?:cddl|common development and distribution {l})
boost | 2 | boost | boost software {l}
artistic | 2 | artistic | (?:perl )?artistic {l}
ofl | 2 | font | open font {l}
eupl | 2 | eupl european | (?:eupl|european union public {l})
python | 2 | python psf | (?:python software foundation|psf) {l}
php | 2 | php | php {l}
ruby | 2 | ruby | ruby {l}
perl | 2 | perl | (?:under )?the same terms as perl(?: itself)?
openssl | 2 | openssl | openssl {l}
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 2 | wtfpl | wtfpl
odbl | 2 | database | open database {l}
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc | 2 | cc | cc by nc
cc-by-nd | 2 | cc | cc by nd
cc-by-sa | 2 | cc | cc by sa
cc-by-sa | 2 | sharealike alike | attribution share ?alike
cc | 2 | creative | creative commons(?: {l}| attribution)?
cc0 | 2 | zero | (?:creative commons zero|cc zero)
public-domain | 2 | domain | (?:dedicated|released|placed|donated|is|are) (?:to|into|in) the public domain
public-domain | 2 | domain | public domain (?:dedication|work|mark)
dual | 2 | dual dually | (?:dual|dually) licen[cs]ed
eula | 2 | user | end user {l} agreement
royalty-free | 2 | royalty | royalty free {l}
by-permission | 2 | permission | (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission
no-reproduction | 2 | part | no part of this [^ ]+ may be (?:reproduced|copied|stored|transmitted)
see-license | 2 | license licence | see (?:the )?(?:file )?{l}(?: file| txt| md)? for (?:more )?(?:details|information|terms)
copyright | 1 | copyright | copyright(?: c)?(?: [^ ]+)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 1 | copyrighted | (?:is|are) copyrighted(?: by)?
copyright | 1 | copr | copr (?:19|20)[0-9]{2}
trademark | 1 | trademark trademarks | (?:registered )?trademarks? of
warranty-disclaimer | 1 | warranty warranties | without (?:any )?warrant(?:y|ies)(?: of any kind)?
as-is | 1 | provided | (?:is|are) provided as is
some-rights | 1 | rights | some rights reserved
no-rights | 1 | rights | no rights reserved
license-mention | 1 | license licence | under (?:this|our|its|your|their) {l}
"""
