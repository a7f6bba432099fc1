"""The library's own small lexicons, and those that a caller brings as a table.

``Lexicon`` holds lists by name. ``DEFAULT`` has the lists of this module; ``read_lexicon`` takes a table (list, ord, key,
value), one row for each entry, and puts its lists in the place of those of the same name. Jobs take a Lexicon and compile its
lists into patterns and literals once, when the plan is made.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame

# Surnames by how many bear them (census of Taiwan), then those that stories of old times need.
SURNAMES = "陳林黃張李王吳劉蔡楊許鄭謝郭洪曾邱廖賴周徐蘇葉莊呂江何蕭羅高潘簡朱鍾游彭詹胡施沈余盧梁趙顏柯翁魏孫戴方宋范鄧杜傅侯曹薛丁卓馬阮董溫唐藍石蔣古紀姚連馮歐程湯田康姜汪白鄒尤巫龔嚴韓袁金狄包展于任"
#: Surnames of several characters; names with one have up to four.
COMPOUND = ("歐陽", "張簡", "范姜", "司馬", "司徒", "上官", "諸葛", "端木", "皇甫", "尉遲", "夏侯", "公孫", "慕容", "令狐", "東方", "鍾離")
NICK_PREFIX = "阿小老"

# Classes of characters that rules out of names are put together from.
PARTICLES, COMPLEMENTS, COPULAS = "的地得嗎呢吧啊", "了著過完起", "是在有"
DIRECTIONS, AMOUNTS, NUMBERS = "上下前後內外中間裡邊", "多少大小些點", "幾兩三四五六七八九十百千"
CONJUNCTIONS, ADVERBS, CONTRASTS = "和與跟同及或", "也都就便又再還只才很更最", "但卻而則"
PREPOSITIONS, NEGATIONS, MODALS = "向對往朝從由把將被讓給替為", "不沒未勿別先", "要能可會敢"
SPEECH, SENSES = "說道問答喊叫", "看聽見想知"
MOTIONS, HANDLING = "走去來進出站坐跑", "拿放開關動笑哭"
PRONOUNS, QUESTIONS = "我你您妳他她它其們", "誰何什怎哪"
#: Second characters that make a nickname prefix an ordinary word: grammar, and what the old and the small are called.
NICK_BAD = PARTICLES + COMPLEMENTS + COPULAS + DIRECTIONS + AMOUNTS + "人兒師太爺婆公伯姨闆家頭子孩姐時候心聲便東西樣麼"
#: What a thing, not a person, ends in.
THING_TAIL = "刀劍槍筆紙信錢藥杯碗車船機門窗房衣鞋帽"
#: Characters before a name besides the start of a text: punctuation, particles, prepositions, complements.
# Punctuation and blanks.
HARD_BOUND = "，。！？：；、,.!?:;」』】）)…—「『【（( \n\t\r　"
SOFT_BOUND = PARTICLES[:3] + COMPLEMENTS + COPULAS + CONJUNCTIONS + ADVERBS + CONTRASTS + PREPOSITIONS + "問看聽見叫"
NAME_BOUND = HARD_BOUND + SOFT_BOUND
# What may stand before a surname and a role besides a bound.
ROLE_BOUND = "和跟與同向對找問叫要請帶"
NOT_NAME_START = CONJUNCTIONS + PREPOSITIONS + CONTRASTS + ADVERBS + COPULAS + PARTICLES[:1] + COMPLEMENTS[:1] + SPEECH + SENSES + MODALS[:3] + NEGATIONS
BAD_CHARS = PRONOUNS + QUESTIONS + NUMBERS
BAD_TAIL = PARTICLES + COMPLEMENTS + COPULAS + CONJUNCTIONS + ADVERBS + CONTRASTS + PREPOSITIONS + SPEECH + SENSES + MOTIONS + HANDLING + DIRECTIONS
NOT_NAMES = ("高聲", "高興", "高大", "小心", "老人", "小姐", "許多", "黃昏", "石頭", "沈默", "大家", "眾人", "忽然", "於是", "然後", "後來", "當時", "突然")
CLAUSE_STOP = ("於是", "然後", "後來", "忽然", "突然", "當時", "眾人", "大家", "不久", "只見")

ROLES = ("探長", "警官", "刑警", "醫生", "老闆", "護士", "偵探", "母親", "父親", "船長")
KIN = ("母親", "父親")
TITLES = ("探長", "警官", "醫生", "先生", "小姐")
FULL_NAMES = ("呂明山", "白玉蘭")
ALIASES = (("山仔", "呂明山"), ("蘭姊", "白玉蘭"))
#: Verb and how often it counts.
SPEAK = (("說道", 2), ("問道", 1), ("答道", 1), ("說", 1), ("問", 1), ("喊", 1))
MOVES = (("走進", 1), ("推開", 1), ("轉身", 1))
# What leads to the name of a speaker.
INTRO = ("我叫", "我是", "名字叫", "叫作")

INDOOR = ("書房", "客廳", "廚房", "走廊", "衙門", "客棧")
OUTDOOR = ("碼頭", "花園", "街上", "河邊", "衙門口", "樹林")
PLACES = tuple((p, "室內") for p in INDOOR) + tuple((p, "室外") for p in OUTDOOR)

# The styles, eras and seasons that a text is classified by, and the patterns that count for them.
STYLES = (
    ("賽博龐克", "賽博|機器人|霓虹|晶片"),
    ("日系動畫", "校園|社團|教室|青春"),
    ("黑色電影", "偵探|命案|線索|證據|密室|屍體|凶手|兇手|黑幫|走私|幫派"),
)
DEFAULT_STYLE = "寫實電影感"
ERA_CERTAIN = "衙門|縣衙|公堂|客棧|師爺|捕快|轎子|馬車"
ERA_WEAK = "太爺|大人|老爺|江湖|銀兩"
ERA_NEAR = "旗袍|留聲機|人力車|電報|日治"
ERA_MODERN = "電話|汽車|警察|旅館|機車|報紙|電視|分局"
SEASONS = (
    ("冬", "冬天，濕冷", (("雪|冬天|寒冷|寒風|寒流", 2), ("冬至|過年|春節", 2), ("十二月|一月|二月", 1))),
    ("春", "春天，地面微濕", (("春天|春雨|花開", 2), ("三月|四月|五月", 1))),
    ("夏", "夏天，空氣悶熱", (("夏天|夏日|盛夏|炎熱|蟬聲", 2), ("端午", 2), ("六月|七月|八月", 1))),
    ("秋", "秋天，落葉堆在角落", (("秋天|秋風|落葉|中秋|深秋", 2), ("九月|十月|十一月", 1))),
)
SEASON_POOL = (
    ("連日陰雨，簷角滴水不停", "近代 現代 古裝"),
    ("北風正緊，說話帶著白氣", "近代 現代 古裝"),
    ("烈日當頭，柏油路燙腳", "近代 現代"),
    ("早晚有涼意，葉緣轉黃", "近代 現代 古裝"),
    ("天色陰濕，牆角泛著水痕", "近代 現代 古裝"),
)
MODERN_TECH = "手機|電腦|網路|捷運|超商"
MODERN_BAN = "手機|螢幕|電腦|網路"
ERA_BAN = (("古裝", "手機|電腦|螢幕|西裝|襯衫|霓虹|路燈|汽車|柏油"), ("近代", "手機|電腦|螢幕|霓虹"), ("現代", "油燈|燭台|燈籠|衙|長衫|客棧|馬車"))

# Shot sizes by pattern, in order; moves; reference strengths of a size (face, body).
SIZES = (
    ("手指|手裡|手中|戒指|鑰匙|照片|紙條|血跡|手機|酒杯", "物件"),
    ("眼神|眼睛|嘴角|眉毛|表情|臉", "特寫"),
    ("天空|遠方|遠處|四周|街|人群|窗外", "遠景"),
    ("走進|走出|走過|穿過|來到", "遠景"),
)
MOVE_CYCLE = ("固定", "緩慢左移", "緩慢右移", "輕微晃動")
STRENGTHS = (("大遠景", 0.30, 0.70), ("遠景", 0.30, 0.70), ("中景", 0.85, 0.50), ("近景", 0.90, 0.40), ("特寫", 0.90, 0.35), ("大特寫", 0.90, 0.35), ("物件", None, 0.70))
FEMALE_WORDS = ("母親", "護士", "女兒", "小姐")
MALE_WORDS = ("父親", "探長", "警官", "刑警", "醫生", "船長")
# Last characters of words for kin, by sex.
KIN_FEMALE, KIN_MALE = "婆媽姊妹姐姑姨嬸嫂娘婦", "公伯叔爺哥弟爸"
NAME_FEMALE, NAME_MALE = "美麗花芳玲珍玉珠蘭", "雄強明華國信義正"

#: Cue lists: phrase in the text, what the picture shows.
CUES = {
    "face": (("皺眉", "眉頭鎖緊"), ("微笑", "嘴角微揚"), ("發抖", "嘴唇顫動")),
    "action": (("推開門", "手掌推開門板"), ("推開", "手臂向前一送"), ("轉身", "身體轉向"), ("低頭", "下巴收起"), ("走進", "跨過門檻")),
    "light": (("月色", "冷白月光"), ("路燈", "路燈光暈"), ("燭光", "燭火搖曳")),
    "object": (("鑰匙", "鑰匙特寫"), ("照片", "照片特寫"), ("信件", "信紙特寫")),
    "noun": (("桌子", "桌面空景"), ("窗外", "窗框外的景")),
    "jump": (("第二天", "轉場：隔日清晨"), ("後來", "轉場：時間推進")),
}
TRAITS = (("忠厚", "神情忠厚老實"), ("憔悴", "面容憔悴"), ("斯文", "舉止斯文"))
KINDS = (("memory", "想起|憶起|往事|小時候"), ("mood", "覺得|心頭|難過|不安|歡喜"), ("time", "後來|次日|傍晚|轉眼"), ("reason", "線索|原因|因此|看來"), ("case", "屍體|命案|失蹤|傷痕"), ("weather", "雨|風|雪|霧|天空"))
MENTAL = 4
ADDRESS = "你知道|你以為|你說呢"
CROWD = "大家|眾人|兩人|他們"
CREDITS = "作者|編者|譯者|轉載自|版權|出版社|印刷"
APPEARANCE = (("戴[著了]?一?副?眼鏡", "戴一副眼鏡"), ("長衫", "穿著長衫"), ("西裝", "穿著西裝"), ("風衣", "穿著風衣"), ("白髮|銀髮", "滿頭白髮"), ("鬍", "蓄著鬍鬚"), ("瘦", "身形瘦削"))
AGES = ("老年", "中年", "年輕", "少年")
NATURE = "花園|樹林|河邊|草"
URBAN_LIGHT = "路燈|招牌|霓虹"

#: Looks: pool, era (empty: all), sex (n: both), values.
POOLS = (
    ("hair", "", "f", ("長髮披肩", "短髮齊耳", "髮髻低挽", "馬尾束高", "微捲中長髮")),
    ("hair", "", "m", ("短髮俐落", "平頭", "側分油頭", "略長的瀏海", "灰白短髮")),
    ("face", "", "n", ("鵝蛋臉", "方臉", "圓臉", "長臉", "瓜子臉", "國字臉")),
    ("eyes", "", "n", ("細長的眼", "大而明亮的眼", "單眼皮", "深邃的眼", "微垂的眼角")),
    ("mark", "", "n", ("左眉有一道淺痕", "右頰一顆痣", "頸上掛玉墜", "指上一只銀戒", "袖口沾著墨跡", "腰間一只手機套")),
    ("outfit", "古裝", "n", ("青布長袍", "灰色短褐", "素色衣裙", "皂衣皂靴", "月白衫子")),
    ("outfit", "近代", "n", ("深色中式短衫", "素色旗袍", "舊呢外套", "白襯衫配吊帶褲", "洋裝")),
    ("outfit", "現代", "n", ("深灰風衣內搭白襯衫", "深色夾克", "針織衫配長褲", "素色洋裝", "制服外套")),
)
#: Outfits by a calling that the name shows, and by style.
ROLE_OUTFITS = (
    ("探長|警官|刑警|偵探", ("長風衣敞著，內裡一件灰毛衣", "藏青夾克，證件夾在腰側", "皂色公服，腰繫一條舊革帶")),
    ("醫生|護士", ("白袍罩著淡色襯衣", "粗布長衫，袖口捲起")),
    ("母親|老闆", ("碎花上衣套著布圍裙", "深藍對襟衫，髮際別一支木簪")),
    ("船長", ("雙排扣呢外套，領口磨白",)),
)
STYLE_OUTFITS = (("黑色電影", ("雨痕未乾的長風衣", "高領黑毛衣配寬褲", "領帶鬆開的灰西裝", "舊皮衣，拉鍊半開")),)
SCENE_TEXTURE = (("室內", ("木桌與書架", "白牆與日光", "舊地板與燭台", "鐵櫃與螢幕")), ("室外", ("石板路面", "泥土小徑", "柏油路與招牌", "水岸與木樁")))
SCENE_LIGHT = (("室內", ("窗光斜入", "燈籠微光", "檯燈聚光")), ("室外", ("午後斜陽", "清晨薄霧", "路燈與招牌交錯")))
SCENE_BY_NAME = (("書房|書", ("整面書牆與一張木桌", "線裝書與油燈", "書櫃玻璃映著螢幕光")), ("碼頭|河", ("潮濕木棧與纜繩", "石階沒入水面")))
#: Textures that belong to a place of their own.
PLACE_SPECIFIC = "水岸|鐵櫃"


class Lexicon(SimpleNamespace):
    """Lists by name: words, pairs of a word and what goes with it, or strings of single characters."""


DEFAULT = Lexicon(**{k: v for k, v in globals().items() if k.isupper() and k != "DEFAULT"})
#: Entries of a lexicon table at most: they become part of every plan that uses them.
MAX_ENTRIES = 50_000
#: Lists whose second half is a number.
WEIGHTED = ("SPEAK", "MOVES")


def read_lexicon(table: DataFrame, base: Lexicon = DEFAULT) -> Lexicon:
    """base with the lists of a table (list, ord, key, value) in place of its own.

    A list is named as in this module in lower case (``roles``, ``places``, ``speak``), a cue list ``cues.face`` and so on.
    Surnames of several characters go to ``COMPOUND``. Entries go by ord, then key; those without a key count for nothing, repeated keys once. Values of pairs default to the key (1
    for weights). An unknown list, or more than MAX_ENTRIES entries, is an error; an empty table changes nothing.
    """
    rows = table.where("key <> ''").select("list", "ord", "key", "value").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the lexicon has more than {MAX_ENTRIES} entries")
    lists: dict[str, dict[str, str | None]] = {}
    for r in sorted(rows, key=lambda r: (r.list, r.ord is None, r.ord, r.key)):
        lists.setdefault(r.list, {}).setdefault(r.key, r.value)
    out = dict(vars(base))
    for name, entries in lists.items():
        head, _, part = name.upper().partition(".")
        known = out.get(head)
        if known is None or bool(part) != isinstance(known, dict):
            raise ValueError(f"no list is named {name}")
        shape = known[part.lower()] if part and part.lower() in known else known
        pairs = isinstance(shape, dict) or (isinstance(shape, tuple) and len(shape) > 0 and isinstance(shape[0], tuple))
        if not isinstance(shape, (str, tuple, dict)) or (isinstance(shape, tuple) and pairs and (len(shape[0]) != 2 or not isinstance(shape[0][1], (str, int)))):
            raise ValueError(f"{name} is no list of words or pairs")
        if head == "SURNAMES":
            out["COMPOUND"] = tuple(k for k in entries if len(k) > 1)
            new = "".join(k for k in entries if len(k) == 1)
        elif isinstance(known, str):
            new = ("|" if "|" in known else "").join(entries)
        elif not pairs:
            new = tuple(entries)
        else:
            new = tuple((k, int(v or 1) if head in WEIGHTED else v if v is not None else k) for k, v in entries.items())
        out[head] = {**known, part.lower(): new} if part else new
    return Lexicon(**out)


#: Pools whose leaves go by one name (a pattern, a style, a type of place), by the list that they fill.
NAMED_POOLS = ("ROLE_OUTFITS", "STYLE_OUTFITS", "SCENE_TEXTURE", "SCENE_LIGHT", "SCENE_BY_NAME")


def pool_rows(lex: Lexicon = DEFAULT) -> list[tuple[str, str, int, str]]:
    """(pool, path, ord, value) of all pools: looks by era/sex, outfits and scenes by name, seasons by name/phrase/weight. A leaf is named as
    often as it stands, so the order of leaves is that of their first rows."""
    leaves = [(kind, f"{era}/{sex}", values) for kind, era, sex, values in lex.POOLS]
    leaves += [(name.lower(), path, values) for name in NAMED_POOLS for path, values in getattr(lex, name)]
    leaves += [("seasons", f"{name}/{phrase}/{weight}", (pattern,)) for name, phrase, clues in lex.SEASONS for pattern, weight in clues]
    out: list[tuple[str, str, int, str]] = []
    for pool, path, values in leaves:
        out += [(pool, path, len(out) + i, v) for i, v in enumerate(values)]
    return out


def read_pools(table: DataFrame, base: Lexicon = DEFAULT) -> Lexicon:
    """base with the pools of a table (pool, path, ord, value) in the place of its own of the same name.

    Paths are those of ``pool_rows``; leaves and values go by ord. Looks (hair, face, eyes, mark, outfit) are pools by era/sex, where an empty era is
    every era and n both sexes. Rows without a value count for nothing. Another pool or path, or more than MAX_ENTRIES rows, is an error.
    """
    rows = table.where("value <> ''").select("pool", "path", "ord", "value").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the pools have more than {MAX_ENTRIES} values")
    leaves: dict[str, dict[str, list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r.ord is None, r.ord or 0, r.path or "", r.value)):
        leaves.setdefault(r.pool, {}).setdefault(r.path or "", []).append(r.value)
    out = dict(vars(base))
    looks = {kind for kind, *_ in base.POOLS}
    for pool, some in leaves.items():
        if pool.upper() in NAMED_POOLS:
            out[pool.upper()] = tuple((path, tuple(values)) for path, values in some.items())
        elif pool == "seasons":
            clues: dict[tuple[str, str], list[tuple[str, int]]] = {}
            for path, values in some.items():
                name, phrase, weight = (path.split("/") + ["", "1"])[:3]
                clues.setdefault((name, phrase), []).extend((v, int(weight)) for v in values)
            out["SEASONS"] = tuple((name, phrase, tuple(found)) for (name, phrase), found in clues.items())
        elif pool in looks:
            if bad := [path for path in some if path.count("/") != 1 or path.split("/")[1] not in ("f", "m", "n")]:
                raise ValueError(f"no leaf of {pool} is named {bad[0]}")
            out["POOLS"] = tuple(p for p in out["POOLS"] if p[0] != pool) + tuple((pool, *path.split("/"), tuple(values)) for path, values in some.items())
        else:
            raise ValueError(f"no pool is named {pool}")
    return Lexicon(**out)
