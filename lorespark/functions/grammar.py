"""Deterministic grammars as column expressions: ordered rules become `when` chains and `coalesce`."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ASCII_SPACES, clean_slot, let, plain_surface, similarity_key, strip

# Vocabularies and patterns of the Japanese grammar.
CONDITIONS = (
    "高温", "低温", "常温", "高負荷", "低負荷", "過負荷", "空腹", "満腹", "雨天", "晴天", "曇天", "降雨時", "降雪時", "夜間", "昼間",
    "異常", "正常", "緊急時", "停止時", "起動時", "終了時", "実行時", "動作時", "待機時", "接続時", "切断時", "通信時", "学習時", "推論時",
    "訓練時", "高圧", "低圧", "高電圧", "低電圧", "高湿度", "低湿度",
)
LEADING = "、，," + ASCII_SPACES
CONDITION_ENDS = "(?:時|中|時点|状態|環境|状況|条件)$"
WEATHER = "(?:雨|雪|晴|曇).*(?:日|天|時)$"
SCALAR_STATE = "(?:高|低|過)(?:温|負荷|圧|電圧|湿度)$"
HINTS = ("日本", "東京", "文学", "数学", "CPU", "GPU", "AI", "LLM", "CUDA")
QUESTION_ENDS = "どうなる|どうなりますか|どうなるの|どうなります|何が起きる|何が起こる"
RELATION_MARKS = "を利用可能|を利用する|を使用する|に依存する|に接続する|を含む|に属する|と関係する|から成る|で構成される"
CAPABILITY_MARKS = "が得意|を実行できる|ができる|できる|が可能|可能である|に対応|を処理できる|を生成できる|を計算できる"
DEFINITION_ENDS = "装置|言語|モデル|技術|基盤|システム|方式|手法|概念|分野|生物"
LINE_ENDS = "\u0085\u2028\u2029"  # at the end of a value they hide no definition
DEFINITION_MARKS = "の一種|一種の|を指す|と呼ばれる"
RELATION_CUES = "の関係|との関係|とどう関係|何を利用|何に依存|何と接続|何を含む"
CAPABILITY_CUES = "何が得意|何を得意|何ができる|何をできる|できること|の能力|の機能"
PROPERTY_CUES = "の性質|の特徴|どんな性質|どんな特徴|特徴は|性質は"
DEFINITION_CUES = "とは|の定義|を定義|って何"
GREETINGS = (
    "こんにちは|こんばんは|おはよう|おはようございます|はじめまして|お疲れさま|お疲れ様|ありがとう|ありがとうございます|"
    "さようなら|またね|やあ|hello|hi"
)
COMPARISON = "より|同じ|異な|違い|似て|類似|比較"
FUNCTION = "使う|使って|使われ|使用|働く|働いて|実行|処理|行う|役割|仲介|利用"
CAUSE = "原因|起因|によって|なので|ゆえに|結果として|ために生じ|ために起き"
DEFINITION = "と言われ|と呼ば|である|であり|とは"
NEGATIONS = "ではない|でない|しない|できない|行わない|利用しない|不可能|存在しない"
NOUN = "[一-龯々ァ-ヶーA-Za-z0-9・]"
STOP_TERMS = ("もの", "こと", "ため", "これ", "それ", "ある", "いる", "なる", "できる")
STOP_CONCEPTS = ("これ", "それ", "あれ", "ここ", "そこ", "ため", "もの", "こと", "私", "あなた", "貴方", "人間", "場合", "よう", "ところ")


def group(text: Column, pattern: str, i: int = 1) -> Column:
    """A group of a pattern, null where it does not match or the group is empty; text is computed and matched once."""
    return let(F.regexp_extract(text, pattern, i), lambda found: F.when(found != "", found))


# --- propositions


# Parts of a copular statement, each of the one before; ends are cut without patterns.


def _head(plain: Column) -> Column:
    return F.when(plain.contains("は"), F.substring_index(plain, "は", 1))


def _body(plain: Column, head: Column) -> Column:
    return F.ltrim(F.substr(plain, F.length(head) + 2), F.lit(LEADING))


def _core(body: Column) -> Column:
    return F.when(body.endswith("である"), strip(F.substr(body, F.lit(1), F.length(body) - 3)))


def _values(core: Column) -> Column:
    """Separators and white space around であり fall with the ends of the parts."""
    part = lambda v: plain_surface(F.ltrim(v, F.lit(LEADING)))
    many = F.array_distinct(F.filter(F.transform(F.split(core, "であり"), part), lambda v: v != ""))
    return F.when(core.contains("であり"), many).when(part(core) != "", F.array(part(core))).otherwise(F.array().cast("array<string>"))


def _whole(subject: Column, core: Column) -> Column:
    return (F.length(subject) > 0) & (F.length(core) > 0)


def decomposed(text: Column) -> Column:
    """Struct (subject, values) of a copular statement; null if it is none. Text in NFKC. Every part is computed once."""

    def cut(plain: Column) -> Column:
        return let(group(plain, "(?s)^(.*?)は"), lambda head: F.struct(plain_surface(head).alias("subject"), let(_body(plain, head), _core).alias("core")))

    def split(p: Column) -> Column:
        return F.when(_whole(p["subject"], p["core"]), F.struct(p["subject"].alias("subject"), _values(p["core"]).alias("values")))

    return let(let(plain_surface(text), cut), split)


def with_decomposed(rows: DataFrame, text: str) -> DataFrame:
    """E1 for a whole table, in steps that Spark compiles: rows with subject and values, both null where text is no copular
    statement. Lambda variables, as in `decomposed`, are interpreted row by row."""
    kept = rows.columns
    rows = rows.select(*kept, plain_surface(F.col(text)).alias("_plain"))
    rows = rows.select(*kept, "_plain", _head(F.col("_plain")).alias("_head"))
    rows = rows.select(*kept, plain_surface(F.col("_head")).alias("subject"), _body(F.col("_plain"), F.col("_head")).alias("_body"))
    rows = rows.select(*kept, "subject", _core(F.col("_body")).alias("_core"))
    whole = _whole(F.col("subject"), F.col("_core"))
    return rows.select(*kept, F.when(whole, F.col("subject")).alias("subject"), F.when(whole, _values(F.col("_core"))).alias("values"))


def composed(subject: Column, values: Column) -> Column:
    """A3: a copular statement of ordered values; empty without values."""
    body = F.concat(subject, F.lit("は、"), F.array_join(values, "であり、"), F.lit("である。"))
    return F.when(F.size(values) > 0, body).otherwise("")


def atomic_statement(subject: Column, value: Column) -> Column:
    return F.concat(subject, F.lit("は、"), value, F.lit("である。"))


# --- predicate types (E4, E12), roles (E5)


def predicate_type_of(value: Column) -> Column:
    """E4. Marks are looked for as plain parts, white space is taken out once."""
    holds = lambda text, marks: functools.reduce(operator.or_, [text.contains(m) for m in marks.split("|")])

    def kind(text: Column) -> Column:
        last = F.rtrim(text, F.lit(LINE_ENDS))
        ends = functools.reduce(operator.or_, [last.endswith(e) for e in DEFINITION_ENDS.split("|")])
        return (
            F.when(holds(text, RELATION_MARKS), "relation")
            .when(holds(text, CAPABILITY_MARKS), "capability")
            .when(ends | holds(text, DEFINITION_MARKS), "definition")
            .otherwise("property")
        )

    return let(F.translate(plain_surface(value), ASCII_SPACES, ""), kind)


def asked_predicate_type(question: Column) -> Column:
    """E12. The questions may be whole texts: they are squeezed once, and cues are looked for as plain parts."""
    holds = lambda q, cues: functools.reduce(operator.or_, [q.contains(c) for c in cues.split("|")])

    def kind(q: Column) -> Column:
        return (
            F.when(holds(q, RELATION_CUES), "relation")
            .when(holds(q, CAPABILITY_CUES), "capability")
            .when(holds(q, PROPERTY_CUES), "property")
            .when(holds(q, DEFINITION_CUES), "definition")
        )

    squeezed = functools.reduce(lambda q, space: F.replace(q, F.lit(space), F.lit("")), " \t\n\v\f\r", question)
    return let(squeezed, kind)


def role_of(answer: Column) -> Column:
    return (
        F.when(answer.rlike(COMPARISON), "comparison")
        .when(answer.rlike(FUNCTION), "function")
        .when(answer.rlike(CAUSE), "cause")
        .when(answer.rlike(DEFINITION), "definition")
        .otherwise("property")
    )


# --- conditions (E6 to E9). `source` is a column in the form of text.surface


CANONICAL = r"^\s*(.+?)\s*は\s*[、,]?\s*(.+?)\s*の場合\s*[、,]?\s*(.+?)\s*$"


def condition_reason(modifier: Column) -> Column:
    """Why a modifier is a condition; null if that is not proven."""

    def why(m: Column) -> Column:
        return (
            F.when(m == "", None)
            .when(m.endswith("場合"), "explicit 場合 condition")
            .when(m.isin(*CONDITIONS), "condition lexicon")
            .when(m.rlike(CONDITION_ENDS), "condition suffix")
            .when(m.rlike(WEATHER), "weather condition")
            .when(m.rlike(SCALAR_STATE), "scalar state condition")
        )

    return let(F.regexp_replace(plain_surface(modifier), r"\s+", ""), why)


def normal_condition(text: Column) -> Column:
    """Without 時 where the rest is a condition; without のとき and の場合."""
    bare = lambda v: strip(F.regexp_replace(F.regexp_replace(v, "のとき$", ""), "の場合$", ""))
    either = lambda v: let(strip(group(v, "^(.+)時$")), lambda b: F.when(condition_reason(b).isNotNull(), b).otherwise(bare(v)))
    return let(plain_surface(text), either)


def rewritten(source: Column) -> Column:
    """Struct (normalized, transformed, subject, modifier, predicate), the modifier of a subject as its condition.

    Boundaries の are tried from the right; the first whose left side is a proven condition wins.
    """
    say = lambda s, m, p: F.concat(s, F.lit("は、"), m, F.lit("の場合、"), p)

    def result(normalized, transformed, subject=None, modifier=None, predicate=None) -> Column:
        fields = (("subject", subject), ("modifier", modifier), ("predicate", predicate))
        rest = [(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in fields]
        return F.struct(normalized.alias("normalized"), transformed.alias("transformed"), *rest)

    c = [plain_surface(F.regexp_extract(source, CANONICAL, i)) for i in (1, 2, 3)]
    shape = r"^\s*(.+?)\s*は\s*(.+?)\s*$"
    predicate = plain_surface(group(source, shape, 2))

    def best(left: Column) -> Column:
        cuts = F.filter(F.sequence(F.length(left), F.lit(1), F.lit(-1)), lambda i: F.substring(left, i, F.lit(1)) == "の")
        sides = F.transform(
            cuts,
            lambda i: F.struct(
                plain_surface(F.substring(left, F.lit(1), i - 1)).alias("modifier"),
                plain_surface(F.substring(left, i + 1, F.length(left))).alias("subject"),
            ),
        )
        proven = F.filter(sides, lambda s: (s["subject"] != "") & condition_reason(s["modifier"]).isNotNull())
        return F.when(F.length(left) > 0, F.get(proven, F.lit(0)))

    def decide(b: Column) -> Column:
        found = b.isNotNull() & (F.length(predicate) > 0)
        new = say(b["subject"], b["modifier"], predicate)
        return (
            F.when(source.rlike(CANONICAL), result(say(*c[:2], c[2]), F.lit(False), *c))
            .when(found, result(new, new != source, b["subject"], b["modifier"], predicate))
            .otherwise(result(source, F.lit(False)))
        )

    return let(let(plain_surface(group(source, shape, 1)), best), decide)


def conditional_query(source: Column) -> Column:
    """Struct (subject, condition) of the first of four question forms whose condition is proven; else null."""
    forms = (
        (rf"^(.+?)の場合[、,]?\s*(.+?)(?:は)?(?:{QUESTION_ENDS})$", 2, 1),
        (r"^(.+?)が(.+?)(?:のとき|の時|時)(?:は)?$", 1, 2),
        (r"^(.+?)(?:時|の場合)の(.+?)(?:は)?$", 2, 1),
        (r"^(.+?)は[、,]?(.+?)の場合[、,]?(?:どうなる|どうなりますか|どうなるの|何が起きる|何が起こる)$", 1, 2),
    )

    def tried(pattern: str, s: int, c: int) -> Column:
        asked = F.struct(plain_surface(group(source, pattern, s)).alias("subject"), normal_condition(group(source, pattern, c)).alias("condition"))
        return let(asked, lambda q: F.when((F.length(q["subject"]) > 0) & condition_reason(q["condition"]).isNotNull(), q))

    return F.coalesce(*[tried(*f) for f in forms])


def conditional_statement(source: Column) -> Column:
    """Struct (subject, condition, predicate) of an explicit or rewritten conditional; else null."""

    def statement(r: Column, condition: Column) -> Column:
        ok = F.when(source.rlike(CANONICAL), condition_reason(condition).isNotNull()).otherwise(r["transformed"])
        return F.when(ok, F.struct(r["subject"].alias("subject"), condition.alias("condition"), r["predicate"].alias("predicate")))

    return let(rewritten(source), lambda r: let(normal_condition(r["modifier"]), lambda c: statement(r, c)))


def runtime_input(source: Column, raw: Column) -> Column:
    """Commands as they are; conditional questions and modifiers in their canonical forms."""
    asked = let(conditional_query(source), lambda q: F.concat(q["subject"], F.lit("は、"), q["condition"], F.lit("の場合、どうなる")))
    changed = let(rewritten(source), lambda r: F.when(r["transformed"], r["normalized"]))
    return F.when(strip(raw).startswith("/"), strip(raw)).otherwise(F.coalesce(asked, changed, source))


# --- questions

# Forms of questions, in order.
FOCUS_FORMS = (
    "^(.+?)とは$",
    "^(.+?)って何$",
    "^(.+?)について教えて$",
    "^(.+?)を説明して$",
    "^(.+?)を簡単に説明して$",
    r"^([^\s。、！？?]{1,24})は$",
)


def concept_focus(question: Column) -> Column:
    """E10 without the guard on greetings: the concept of an explicit question; else empty."""
    q = strip(question)
    return F.coalesce(*[strip(group(q, p)) for p in FOCUS_FORMS], F.lit(""))


def query_focus(question: Column) -> Column:
    """The concept a question is about; empty for greetings and others."""
    return F.when(F.lower(strip(question)).rlike(f"^(?:{GREETINGS})"), "").otherwise(concept_focus(question))


# The forms that the queue knows, in order.
QUEUE_FORMS = ("^(.+?)とは$", "^(.+?)って何$", "^(.+?)について教えて$", "^(.+?)を説明して$", "^(.+?)を簡単に説明して$", "^(.+?)は$")


def queue_concept(question: Column) -> Column:
    """E10 as the queue has it: the concept of one of six forms, or a bare word of up to 40 characters; else empty."""
    q = F.regexp_replace(strip(question), "[。、，, ]+$", "")
    bare = F.when((F.length(q) <= 40) & ~q.rlike(r"[\s。、！？!?，,:：;；]"), q).otherwise("")
    return F.coalesce(*[strip(group(q, p)) for p in QUEUE_FORMS], bare)


def bare_focus(question: Column) -> Column:
    """A bare concept: an ASCII identifier or kanji and katakana, at most 24 characters; else empty."""
    q = strip(question)
    return F.when((F.length(q) <= 24) & q.rlike(r"^(?:[A-Za-z][A-Za-z0-9_+\-]*|[一-龯々ァ-ヶー]+)$"), q).otherwise("")


# Words for persons, and bare words that one may say, without asking about a concept.
PERSONS = ("あなた", "貴方", "きみ", "君", "おまえ", "お前", "わたし", "私", "ぼく", "僕")
BARE_ALLOWED = ("長門", "長門有希", "hello", "hi")


def bare_concept(question: Column) -> Column:
    """A question that is only a concept, an identifier or kanji and katakana of 2 to 24 characters; else empty."""
    q = strip(question)
    return F.when(q.rlike(r"^(?:[A-Za-z][A-Za-z0-9_+.#\-]{1,23}|[一-龯々ァ-ヶー]{2,24})\z"), q).otherwise("")


def definition_focus(question: Column) -> Column:
    q = strip(question)
    forms = ("^(.+?)とは(?:何)?$", "^(.+?)って何$", "^(.+?)について(?:教えて|説明して)$", "^(.+?)を(?:簡単に)?説明して$")
    return F.coalesce(*[strip(group(F.regexp_replace(q, "[。！？!?]+$", ""), p)) for p in forms], F.lit(""))


def intent(question: Column) -> Column:
    """Struct (intent, slots)."""
    q = strip(question)
    greets = F.lower(q).rlike("こんにちは|こんばんは|おはよう|お疲れ|はじめまして|やあ|hello|hi")
    compare = r"(?i)^\s*([^\s、。！？?と]{1,30})\s*と\s*([^\s、。！？?]{1,30}?)\s*(?:を|の)?(?:違い|差|比較|違う点)"
    two = F.array(clean_slot(F.regexp_extract(q, compare, 1)), clean_slot(F.regexp_extract(q, compare, 2)))
    focus = definition_focus(q)
    none = F.array().cast("array<string>")
    say = lambda name, slots: F.struct(F.lit(name).alias("intent"), slots.alias("slots"))
    return (
        F.when(greets, say("greeting", none))
        .when(q.rlike(compare), say("comparison", two))
        .when(focus != "", say("definition", F.array(focus)))
        .otherwise(say("general", none))
    )


def input_fault(text: Column) -> Column:
    """The first reason to reject an input; null if it is fine."""
    q = strip(text)
    key = similarity_key(q)
    names = "(?i)(?:AI|CPU|GPU|LLM|CUDA)"
    hits = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"(?i)\b(AI|CPU|GPU|LLM|CUDA)\b"), F.lit(1)), F.upper))
    bare = strip(F.regexp_replace(q, "[、。！？?! ]+$", ""))
    return (
        F.when(q == "", "empty input")
        .when(bare.isin("とは", "って", "なに", "何", "何ですか", "教えて", "説明して", "について", "は", "を", "の"), "missing query subject")
        .when(q.rlike("(?:とは){2,}|(?:って){2,}"), "malformed repeated intent")
        .when(q.rlike(f"^{names}[一-龯]$"), "malformed technical-term suffix")
        .when((F.size(hits) >= 2) & q.contains("とは") & ~q.rlike("違い|比較|差"), "incoherent multi-concept input")
        .when(
            (F.length(key) <= 6)
            & q.rlike(names)
            & (definition_focus(q) == "")
            & ~q.rlike("について|説明|教えて|違い|比較")
            & ~F.upper(key).isin("AI", "CPU", "GPU", "LLM", "CUDA"),
            "malformed short technical query",
        )
    )


# Reasons that mark a fault of the input, and a gap in what was learned.
INPUT_MARKS = (
    "malformed repeated intent|malformed technical-term suffix|incoherent multi-concept input|malformed short technical query|"
    "empty input|missing query subject"
)
LEARNING_MARKS = (
    "definition answer is only an echo|definition answer is uninformative|concept slot missing|answer concept missing|"
    "answer concept conflict"
)


def resolution(accepted: Column, reason: Column, question: Column) -> Column:
    """Struct (resolution, action) of an answer that was accepted or rejected for a reason."""
    focus = definition_focus(question)
    unknown = (focus != "") & ~F.lower(focus).isin("ai", "人工知能", "cpu", "gpu", "llm", "大規模言語モデル", "cuda")
    say = lambda a, b: F.struct(F.lit(a).alias("resolution"), F.lit(b).alias("action"))
    return (
        F.when(accepted, say("ACCEPT", "none"))
        .when(reason.rlike(INPUT_MARKS), say("INPUT_REJECT", "ask/rephrase"))
        .when(reason.contains("unknown entity missing"), say("UNKNOWN_KNOWLEDGE", "retrieve/teach"))
        .when(reason.rlike(LEARNING_MARKS), say("LEARNING_GAP", "teach/train"))
        .when(unknown, say("UNKNOWN_KNOWLEDGE", "retrieve/teach"))
        .otherwise(say("GATE_REVIEW", "review/gate"))
    )


# --- function slots (E17), concepts (A8, E19), terms

# Names of actions and their words, in order.
ACTIONS = (
    ("execute", "実行"),
    ("process", "処理"),
    ("use", "利用|使用|使う|使って|使われ"),
    ("operate", "働く|動作"),
    ("perform", "行う|行い"),
    ("mediate", "仲介"),
)


def function_slots(answer: Column, actions: tuple[tuple[str, str], ...] = ACTIONS) -> Column:
    """Struct (action, target, purpose); actions are ordered (name, pattern) rules."""
    action = F.coalesce(*[F.when(answer.rlike(p), F.lit(a)) for a, p in actions], F.lit("function"))
    # evidence may be long: the slow patterns run only where a text holds a part that they need
    held = lambda *parts: functools.reduce(operator.or_, [answer.contains(p) for p in parts])
    target = F.coalesce(
        F.when(held("を"), group(answer, rf"({NOUN}{{1,24}})を(?:同時に)?(?:実行|処理|利用|使用|仲介)")),
        F.when(held("して"), group(answer, rf"(?:実行|処理|利用|使用|動作)して(?:いる|いた)?({NOUN}{{1,24}})")),
        F.when(held("使われる", "使用される"), group(answer, rf"(?:使われる|使用される)(?:ための|対象の)?({NOUN}{{1,24}})")),
        F.lit("unspecified"),
    )
    before = F.when(held("ために", "ための", "為に", "為の"), group(answer, "(.{2,50}?)(?:ために|ための|為に|為の)"))
    short = lambda clause: F.when(F.length(clause) > 40, F.substring(clause, -40, 40)).otherwise(clause)
    purpose = F.coalesce(
        let(strip(F.regexp_replace(before, "^.*?[、,]", "")), lambda clause: F.when(clause == "", "unspecified").otherwise(short(clause))),
        F.when(held("命令") & answer.rlike("命令.*実行"), "computation"),
        F.when(held("情報") & answer.rlike("情報.*処理"), "information_processing"),
        F.lit("unspecified"),
    )
    return F.struct(action.alias("action"), target.alias("target"), purpose.alias("purpose"))


def informative_slots(slots: Column) -> Column:
    """How many slots say something."""
    return (
        (slots["action"] != "function").cast("int")
        + (slots["target"] != "unspecified").cast("int")
        + (slots["purpose"] != "unspecified").cast("int")
    )


# How statements begin that are about a concept, in order.
CONCEPT_FORMS = ("^([^、。！？!?]{2,24})は", "^([^、。！？!?]{2,24})も", "^([^、。！？!?]{2,24})とは", "^([^、。！？!?]{2,24})の定義は")


def leading_concept(sentence: Column) -> Column:
    """The concept of the first form that matches, if it is plausible; else null."""
    first = F.coalesce(*[group(sentence, p) for p in CONCEPT_FORMS])
    concept = strip(F.regexp_replace(strip(first), "(?:も|が|を|に|で)$", ""))
    return let(concept, lambda c: F.when(plausible_concept(c), c))


def plausible_concept(text: Column) -> Column:
    t = F.regexp_replace(text, r"^[ 、。・()（）\[\]「」『』]+|[ 、。・()（）\[\]「」『』]+$", "")
    return (
        F.length(t).between(2, 24)
        & ~t.rlike(r"[\s、。！？!?：:；;,]")
        & ~t.rlike("^[0-9０-９]+$")
        & ~t.isin(*STOP_CONCEPTS)
    )


def required_terms(answer: Column, concept: Column) -> Column:
    """The content terms an answer must keep, in order, at most eight."""
    stop = F.array(*[F.lit(w) for w in STOP_TERMS])

    def tail(p: Column) -> Column:
        rest = F.when((p["name"] != "") & F.startswith(p["text"], p["name"]), F.substring(p["text"], F.length(p["name"]) + 1, F.length(p["text"]))).otherwise(p["text"])
        return F.regexp_replace(F.regexp_replace(rest, "^(?:は|とは)", ""), "(?:である|です|だ)$", "")

    def listed(p: Column) -> Column:
        adds = p["category"].isNotNull() & (p["category"] != concept) & ~F.array_contains(p["terms"], p["category"])
        return F.slice(F.when(adds, F.array_append(p["terms"], p["category"])).otherwise(p["terms"]), 1, 8)

    keys = F.struct(similarity_key(answer).alias("text"), similarity_key(concept).alias("name"))
    parts = F.split(let(keys, tail), "(?:を|に|で|が|は|と|して|する|行う|利用|ため|の)")
    terms = F.array_distinct(F.filter(F.transform(parts, strip), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))
    ended = answer.contains("である") | answer.contains("です") | answer.contains("だ")
    category = F.when(ended, group(strip(answer), "([一-龯々ァ-ヶーA-Za-z0-9]{2,12})(?:である|です|だ)$"))
    return let(F.struct(terms.alias("terms"), category.alias("category")), listed)


def negative(text: Column) -> Column:
    return text.rlike(NEGATIONS)


def polarity_differs(a: Column, b: Column) -> Column:
    """E22."""
    return negative(a) != negative(b)


def malformed(text: Column) -> Column:
    """Empty, with a replacement character, or (8 characters or more) one 1- to 4-gram over 45 % of its kind."""

    def share(key: Column, n: int) -> Column:
        total = F.length(key) - F.lit(n - 1)
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), total), lambda i: F.substring(key, i, F.lit(n))))
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(s: Column, g: Column) -> Column:
            run = F.when(g == s["last"], s["run"] + 1).otherwise(1)
            return F.struct(g.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

        return F.aggregate(grams, start, step, lambda s: s["most"]) / total

    def repeats(key: Column) -> Column:
        high = F.lit(False)
        for n in (1, 2, 3, 4):
            high = high | (share(key, n) > 0.45)
        # an n-gram's first character is as frequent as the n-gram: few texts have such a one, and only their grams are sorted
        often = F.exists(F.array_distinct(F.split(key, "")), lambda c: F.length(key) - F.length(F.replace(key, c, F.lit(""))) > (F.length(key) - 3) * 0.45 - 1e-6)
        return F.when((F.length(key) >= 8) & often, high).otherwise(False)

    return F.coalesce((text == "") | text.contains("�") | let(similarity_key(text), repeats), F.lit(True))


# Short names that ask for the identity, and the answer of a model that does not know.
IDENTITY_ALIASES = ("長門", "長門有希", "長門とは", "長門有希とは")
IDENTITY_QUERY = "あなたは誰ですか"
UNKNOWN_REPLY = "未学習です"


def identity_query(question: Column) -> Column:
    """Short names become the identity question."""
    return F.when(strip(question).isin(*IDENTITY_ALIASES), IDENTITY_QUERY).otherwise(question)


def rejection_label(gated: Column, raw: Column) -> Column:
    """What gating did to an answer."""
    missing = (F.coalesce(gated, F.lit("")) == "") | (F.coalesce(raw, F.lit("")) == "")
    passed = F.when(gated != UNKNOWN_REPLY, "PASS").when(raw != UNKNOWN_REPLY, "FALSE_REJECT").otherwise("MODEL_FAIL")
    return F.when(missing, "PARSE_FAIL").otherwise(passed)


def answer_spans(answer: Column) -> Column:
    """The parts between punctuation and words of contrast, then the whole answer if it is none of them."""
    parts = F.filter(F.transform(F.split(answer, "[。！？!?、,]|一方|対して"), strip), lambda s: s != "")
    whole = strip(answer)
    return F.when((whole == "") | F.array_contains(parts, whole), parts).otherwise(F.array_append(parts, whole))


def role_object(subject: Column, answer: Column) -> Column:
    """The answer without its subject and its last full stop; null if nothing is left."""
    bare = F.regexp_replace(answer, "。$", "")
    after = lambda tail: F.when(F.startswith(bare, F.concat(subject, F.lit(tail))), F.substr(bare, F.length(subject) + len(tail) + 1))
    return F.nullif(strip(F.coalesce(after("は、"), after("は"), bare)), F.lit(""))


def slots_overlap(a: Column, b: Column) -> Column:
    """Do two arrays share a member, whatever its case?"""
    return F.arrays_overlap(F.transform(a, F.lower), F.transform(b, F.lower))


def required_coverage(answer: Column, teacher: Column, concept: Column) -> Column:
    """M4: the share of the teacher's required terms (E21) that the answer holds; 1 without any."""

    def share(p: Column) -> Column:
        held = F.filter(p["terms"], lambda t: p["key"].contains(similarity_key(t)))
        return F.when(F.size(p["terms"]) == 0, 1.0).otherwise(F.size(held) / F.size(p["terms"]))

    return let(F.struct(required_terms(teacher, concept).alias("terms"), similarity_key(answer).alias("key")), share)


def bare_route(question: Column, validated: Column, conversational: Column) -> Column:
    """Struct (routed, focus, blocked). A bare concept that is validated asks for its definition; another one is
    blocked as unknown, unless it is a word of conversation."""
    focus = bare_focus(question)
    known = (focus != "") & validated
    return F.struct(
        F.when(known, F.concat(focus, F.lit("とは"))).otherwise(question).alias("routed"),
        focus.alias("focus"),
        ((focus != "") & ~validated & ~conversational).alias("blocked"),
    )


# What marks questions of identity, of the persona, of knowledge, and paraphrases of these.
IDENTITY_PATTERNS = ("あなたは誰", "名前", "自己紹介")
PERSONA_PATTERNS = (
    "あなたは誰", "自己紹介", "名前", "本は好き", "読書", "人間について", "人について", "感情", "怒って", "楽しい", "寂しい", "好きな場所",
    "好きな時間", "学校は", "勉強は好き", "何をしていますか", "今日はどう", "元気ですか",
)
KNOWLEDGE_PATTERNS = ("AI", "人工知能", "LLM", "大規模言語モデル", "コンピュータ", "GPU", "CUDA", "量子力学", "量子コンピュータ", "Semantic", "セマンティック")
PARAPHRASE_PATTERNS = ("って何", "について教えて", "簡単に説明", "知りたい")
PERSONA_NAME = "長門有希"


def pair_class(user: Column, answer: Column) -> Column:
    """Identity, persona, paraphrase, knowledge or other: the first that fits decides how often a pair is repeated."""
    q = strip(user)
    has = lambda terms: q.rlike("|".join(terms))
    return (
        F.when(has(IDENTITY_PATTERNS), "identity")
        .when(has(PERSONA_PATTERNS) | answer.contains(PERSONA_NAME), "persona")
        .when(has(KNOWLEDGE_PATTERNS) & has(PARAPHRASE_PATTERNS), "paraphrase")
        .when(has(KNOWLEDGE_PATTERNS), "knowledge")
        .otherwise("other")
    )


def pair_copies(user: Column, answer: Column, weights: dict[str, int]) -> Column:
    """Copies of a pair by its class; classes without a weight, and weights under 1, are 1."""
    table = F.create_map(*[F.lit(x) for k, n in weights.items() for x in (k, max(1, n))])
    return F.coalesce(table[pair_class(user, answer)], F.lit(1))
