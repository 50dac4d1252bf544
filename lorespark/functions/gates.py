"""Rules that accept or reject statements, teaching answers and generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import definition_focus, intent
from .propositions import echoes
from .text import clean_slot, let, occurrences, similarity_key

# Names that stand for each other, categories, rules of concepts, cues and hints.
SLOT_ALIASES = {
    "ai": ("ai", "人工知能", "artificial intelligence"),
    "人工知能": ("人工知能", "ai", "artificial intelligence"),
    "llm": ("llm", "大規模言語モデル", "large language model", "言語モデル"),
    "大規模言語モデル": ("大規模言語モデル", "llm", "large language model", "言語モデル"),
    "cpu": ("cpu", "中央処理装置", "central processing unit"),
    "gpu": ("gpu", "画像処理装置", "graphics processing unit"),
    "cuda": ("cuda",),
}
SYNONYMS = {
    "ai": ("ai", "人工知能", "artificial intelligence"),
    "人工知能": ("人工知能", "ai", "artificial intelligence"),
    "llm": ("llm", "大規模言語モデル", "large language model"),
    "大規模言語モデル": ("大規模言語モデル", "llm", "large language model"),
    "cpu": ("cpu", "中央処理装置", "central processing unit"),
    "gpu": ("gpu", "graphics processing unit"),
    "cuda": ("cuda",),
}
CATEGORIES = {
    "量子力学": ("理論", "微視的", "状態", "重ね合わせ", "測定"),
    "量子コンピュータ": ("量子", "計算", "量子ビット", "重ね合わせ"),
    "コンピュータ": ("計算機", "装置", "計算", "情報処理"),
    "semantic": ("意味", "意味論", "セマンティック"),
    "セマンティック": ("意味", "意味論", "セマンティック"),
    "llm": ("言語モデル",),
    "大規模言語モデル": ("言語モデル",),
    "gpu": ("画像処理装置", "プロセッサ", "処理装置"),
    "cpu": ("中央処理装置", "プロセッサ", "処理装置"),
    "ai": ("技術", "システム", "人工知能"),
    "人工知能": ("技術", "システム"),
}
#: concept, terms of which the answer must hold one, terms that it must not hold; the first concept in the question counts.
CONCEPT_RULES = (
    ("gpu", ("gpu", "並列", "演算", "プロセッサ", "画像処理装置"), ("人工知能", "llm", "言語モデル")),
    ("cpu", ("中央処理装置", "プロセッサ", "命令", "制御", "演算"), ("人工知能", "llm", "言語モデル")),
    ("llm", ("llm", "言語モデル", "大規模言語モデル", "言語"), ("画像処理装置", "中央処理装置")),
    ("人工知能", ("人工知能", "知的", "技術", "システム", "ai"), ()),
    ("ai", ("人工知能", "知的", "技術", "システム", "llm"), ()),
)
VACUOUS = ("同じ種類のもの", "同じもの", "ものです", "ものだ", "一種です", "一種だ", "何かです", "何かだ")
INFORMATIVE = ("モデル", "装置", "技術", "方式", "手法", "プロセッサ", "ソフトウェア", "ハードウェア", "システム", "人工知能")
PARTICLES = r"とは|は|って|を|が|に|で|の|です|だ|である|。|、|,|\."
KNOWN_ENTITIES = ("AI", "LLM", "CPU", "GPU", "CUDA")
META_MARKS = ("長門ごっこ", "ネタ", "RT ", "http://", "https://")
HINTS = {
    "ai": "AIは人間の知的な処理をコンピュータで実現する技術です。",
    "人工知能": "人工知能は人間の知的な処理をコンピュータで実現する技術です。",
    "cpu": "CPUは汎用的な命令実行と制御処理を担当する中央処理装置です。",
    "gpu": "GPUは多数の演算を並列に処理するプロセッサです。",
    "llm": "LLMは大量のテキストから学習し、言語を扱う大規模言語モデルです。",
    "大規模言語モデル": "大規模言語モデルは大量のテキストから学習し、言語を扱うモデルです。",
}
GENERAL_HINT = "Provide a concrete, correct answer with the key concept and function."
HINT_TAIL = "について、分類・機能・特徴のいずれかを含む説明を教えてください。"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _looked_up(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _strings(v))])[key]


def _holds(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def usable_statement(concept: Column, statement: Column, least: int, most: int, marks: tuple[str, ...] = META_MARKS) -> Column:
    """does a statement of bounded length hold the concept, four times at most, without asking, exclaiming or a mark?"""
    open_end = statement.rlike(r"[！？!?]\s*$")
    fits = statement.contains(concept) & F.length(statement).between(least, most)
    return fits & (occurrences(statement, concept) <= 4) & ~open_end & ~_holds(statement, marks)


def slot_present(slot: Column, answer: Column) -> Column:
    """does the answer hold the slot or one of its aliases, whatever the case?"""
    low = F.lower(answer)
    return let(F.lower(clean_slot(slot)), lambda k: F.exists(F.coalesce(_looked_up(SLOT_ALIASES, k), F.array(k)), lambda a: low.contains(a)))


def concept_rule(question: Column, answer: Column) -> Column:
    """struct (ok, reason): an answer about a known concept must hold one of its terms and none of another's."""
    asked, said = F.lower(question), F.lower(answer)
    ruled = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), reason.alias("reason"))
    verdict = None
    for key, needed, banned in CONCEPT_RULES:
        bad = F.filter(_strings(banned), lambda t: said.contains(t))
        conflict = F.concat(F.lit(f"answer concept conflict for {key.upper()}: "), F.array_join(bad, ", "))
        missing = F.when(~_holds(said, needed), ruled(False, F.lit(f"answer concept missing for {key.upper()}")))
        row = missing.when(F.size(bad) > 0, ruled(False, conflict)).otherwise(ruled(True, F.lit("answer concept consistent")))
        verdict = F.when(asked.contains(key), row) if verdict is None else verdict.when(asked.contains(key), row)
    return verdict.otherwise(ruled(True, F.lit("no answer concept rule")))


def synonyms(slot: Column) -> Column:
    return F.coalesce(_looked_up(SYNONYMS, F.lower(slot)), F.array(slot))


def uninformative(slot: Column, answer: Column) -> Column:
    """A definition that only echoes a synonym, is vacuous without a term of kind, or leaves under two characters
    beside synonyms and particles. A category of the concept is always informative."""

    def judge(key: Column) -> Column:
        vacuous = _holds(key, VACUOUS) & ~_holds(key, INFORMATIVE)
        categories = F.coalesce(_looked_up(CATEGORIES, F.lower(slot)), _strings(()))
        named = F.exists(categories, lambda c: key.contains(similarity_key(c)))
        names = F.array_sort(F.transform(synonyms(slot), similarity_key), lambda a, b: F.length(b) - F.length(a))
        rest = F.regexp_replace(F.aggregate(names, key, lambda t, n: F.replace(t, n, F.lit(""))), PARTICLES, "")
        return vacuous | (~named & (F.length(rest) < 2))

    return echoes(synonyms(slot), answer) | let(similarity_key(answer), judge)


def teaching_answer(question: Column, answer: Column) -> Column:
    """struct (ok, reason) of an answer that is to be taught."""

    def judge(q: Column) -> Column:
        slot = F.get(q["slots"], F.lit(0))
        defines = (q["intent"] == "definition") & (F.size(q["slots"]) > 0)
        no = lambda why: F.struct(F.lit(False).alias("ok"), F.lit(why).alias("reason"))
        echo = "definition teaching answer is only an echo; teach category/function/property, not only a synonym"
        empty = "definition teaching answer is uninformative; include category, function, or distinguishing property"
        rule = concept_rule(question, answer)
        return (
            F.when(defines & echoes(synonyms(slot), answer), no(echo))
            .when(defines & uninformative(slot, answer), no(empty))
            .when(~rule["ok"], rule)
            .otherwise(F.struct(F.lit(True).alias("ok"), F.lit("teaching answer accepted").alias("reason")))
        )

    return let(intent(question), judge)


def suspicious_entities(text: Column) -> Column:
    """Distinct identifiers with a digit, a hyphen, or (five characters or more) mixed case, in order."""
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_+.#-]{1,39})"), F.lit(1))
    mixed = lambda t: (F.length(t) >= 5) & t.rlike("[a-z]") & t.rlike("^.+[A-Z]")
    return F.array_distinct(F.filter(tokens, lambda t: ~F.upper(t).isin(*KNOWN_ENTITIES) & (t.rlike("[0-9-]") | mixed(t))))


def teaching_hint(question: Column) -> Column:
    """Z3: an example of an answer, or what it should hold."""
    known = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    return let(definition_focus(question), lambda f: F.when(f == "", GENERAL_HINT).otherwise(F.coalesce(known[F.lower(f)], F.concat(f, F.lit(HINT_TAIL)))))
