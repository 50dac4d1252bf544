"""Rich propositions, relation templates and answers composed from evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import function_slots, group, informative_slots
from .text import collapse, let, similarity_key, strip

# Markers, templates and cues.
NEGATIVE = "ではない|でない|しない|存在しない|ない|無い|なく|ぬ"
CONDITION = (r"^([^、。]{2,40}(?:場合|とき|時|なら|では|において))、(.+)$", r"^(この理論では)\s*(.+)$")
CONTEXTS = ("観測上", "外から", "中では", "空間内", "時間軸上", "この世界では")
OBJECT_PREDICATES = (("存在", "exists"), ("進行", "progresses"), ("膨張", "expands"), ("観測", "observed_as"))
RELATIONS = {
    "includes": "を含む",
    "contains": "を含む",
    "is_a": "の一種である",
    "isa": "の一種である",
    "part_of": "の一部である",
    "has": "を持つ",
    "uses": "を使う",
    "related_to": "と関係する",
    "causes": "を引き起こす",
    "depends_on": "に依存する",
}
QUESTION_FORMS = ("", "とは", "について教えて", "を説明して", "って何")
COMPARISON_CUES = "一方|対して|違|比べ|比較|対照|より|得意|汎用|並列|制御"


def rich_proposition(concept: Column, statement: Column) -> Column:
    """Struct (predicate, object, condition, context, polarity); null if the statement does not hold the concept.

    The concept is compared as text, not as a pattern.
    """
    condition = F.coalesce(*[strip(group(statement, p, 1)) for p in CONDITION], F.lit(""))
    body = F.coalesce(*[strip(group(statement, p, 2)) for p in CONDITION], statement)

    def extract(b: Column) -> Column:
        context = F.coalesce(*[F.when(b.contains(m), m) for m in CONTEXTS], F.lit(""))
        after = lambda tail: F.when(F.startswith(b, F.concat(concept, F.lit(tail))), F.substr(b, F.length(concept) + len(tail) + 1))
        tidy = lambda c: F.regexp_replace(F.regexp_replace(c, "^、", ""), "^[ 。]+|[ 。]+$", "")
        said = lambda p, o: F.struct(
            p.alias("predicate"), o.alias("object"), condition.alias("condition"), context.alias("context"), (~b.rlike(NEGATIVE)).alias("polarity")
        )
        whole = F.regexp_replace(b, "。+$", "")
        by_object = lambda o: F.coalesce(*[F.when(o.contains(m), n) for m, n in OBJECT_PREDICATES], F.lit("is"))
        plain = lambda tail: let(tidy(after(tail)), lambda o: F.when(o != "", said(by_object(o), o)))
        meaning = let(tidy(after("の定義は")), lambda o: F.when(o != "", said(F.lit("definition"), o)))
        loose = F.when(b.contains(concept), said(F.lit("related_statement"), whole))
        also = F.when(tidy(after("も")) != "", said(F.lit("related_statement"), whole))
        # the first form that matches decides, also when nothing is left as its object
        found = F.when(after("は") != "", plain("は")).when(after("も") != "", also).when(after("の定義は") != "", meaning)
        return found.when(after("とは") != "", plain("とは")).otherwise(loose)

    return let(body, extract)


def proposition_score(p: Column) -> Column:
    """Sort key of a rich proposition, the best first in descending order."""
    base = F.when(p["predicate"] == "definition", 12).when(p["predicate"] == "related_statement", 2).otherwise(8)
    extra = 2 * (p["condition"] != "").cast("int") + (p["context"] != "").cast("int") + (~p["polarity"]).cast("int")
    n = F.length(p["object"])
    return F.struct((base + extra).alias("score"), (-F.abs(n - 55)).alias("fit"), (-n).alias("short"))


def clause(concept: Column, p: Column) -> Column:
    """D3: a proposition (predicate, object, condition, context) as a clause; its wording carries the polarity."""
    obj = F.regexp_replace(strip(p["object"]), "。+$", "")
    said = (
        F.when(p["predicate"] == "definition", F.concat(concept, F.lit("の定義は、"), obj))
        .when((p["predicate"] == "related_statement") & F.startswith(obj, concept), obj)
        .otherwise(F.concat(concept, F.lit("は、"), obj))
    )
    given = lambda c: F.when((p["condition"] != "") & ~F.startswith(c, p["condition"]), F.concat(p["condition"], F.lit("、"), c)).otherwise(c)
    placed = lambda c: F.when((p["context"] != "") & ~c.contains(p["context"]), F.concat(p["context"], F.lit("では、"), c)).otherwise(c)
    return F.concat(F.regexp_replace(let(let(said, given), placed), "。+$", ""), F.lit("。"))


def relation_sentence(subject: Column, relation: Column, value: Column, condition: Column, context: Column, polarity: Column) -> Column:
    """A relation fact as a sentence; unknown relations are named."""
    tails = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])[relation]
    unknown = F.concat(subject, F.lit("は、"), relation, F.lit("として"), value, F.lit("と関係する"))
    clause = F.coalesce(F.concat(subject, F.lit("は、"), value, tails), unknown)
    clause = F.when(context != "", F.concat(context, F.lit("、"), clause)).otherwise(clause)
    link = F.when(polarity, "の場合、").otherwise("でない場合、")
    clause = F.when(condition != "", F.concat(condition, link, clause)).otherwise(clause)
    return F.concat(F.regexp_replace(clause, "。+$", ""), F.lit("。"))


def question_forms(concept: Column) -> Column:
    """The five questions about a concept."""
    return F.array(*[F.concat(concept, F.lit(tail)) for tail in QUESTION_FORMS])


def rendered_function(subject: Column, evidence: Column) -> Column:
    """A sentence of the slots that evidence gives; the evidence itself if they say nothing."""

    def render(e: Column, s: Column) -> Column:
        parts = F.array_compact(
            F.array(
                F.when(s["action"] != "function", F.concat(F.lit("action="), s["action"])),
                F.when(s["target"] != "unspecified", F.concat(F.lit("target="), s["target"])),
                F.when(s["purpose"] != "unspecified", F.concat(F.lit("purpose="), s["purpose"])),
            )
        )
        said = F.concat(collapse(subject), F.lit("の機能は、"), F.array_join(parts, "、"), F.lit("。根拠: "), e)
        return F.when(informative_slots(s) > 0, said).otherwise(e)

    return let(collapse(evidence), lambda e: let(function_slots(e), lambda s: render(e, s)))


def slot_fault(intent: Column, slots: Column, answer: Column) -> Column:
    """what an answer's slots lack; null if nothing. Slots are compared in lower case."""
    missing = F.filter(slots, lambda s: ~F.lower(answer).contains(F.lower(s)))
    return (
        F.when((intent == "definition") & (F.size(missing) > 0), F.concat(F.lit("definition focus missing: "), F.get(slots, F.lit(0))))
        .when((intent == "comparison") & (F.size(missing) > 0), F.concat(F.lit("comparison slot missing: "), F.array_join(missing, ", ")))
        .when((intent == "comparison") & ~answer.rlike(COMPARISON_CUES), "comparison relation missing")
    )


def definition_surface(text: Column) -> Column:
    """N4 without one copula at the end."""
    return F.regexp_replace(similarity_key(text), "(?:です|である|だ)$", "")


def echoes(synonyms: Column, answer: Column) -> Column:
    """An answer that is only one of the synonyms, or equates two of them."""
    names = F.transform(synonyms, definition_surface)
    equal = lambda a: F.exists(names, lambda x: F.exists(names, lambda y: (x != y) & (a == F.concat(x, F.lit("は"), y))))
    return let(definition_surface(answer), lambda a: F.array_contains(names, a) | equal(a))


def packed(prompt: Column, answer: Column, context: int, pad: int, end: int) -> Column:
    """Struct (x, y, mask) of a prompt and an answer (arrays of ids): the prompt loses its left side first, then the
    answer its right side, which then ends with `end`; y is x one later, and only the answer counts."""
    size = context + 1

    def cut_answer(p: Column) -> Column:
        room = F.greatest(F.lit(1), F.lit(size) - F.size(p))
        short = F.concat(F.slice(answer, F.lit(1), room - 1), F.array(F.lit(end)))
        return F.struct(p.alias("p"), F.when(F.size(p) + F.size(answer) > size, short).otherwise(answer).alias("a"))

    def build(r: Column) -> Column:
        n = F.size(r["p"]) + F.size(r["a"]) - 1
        whole, rest = F.concat(r["p"], r["a"]), F.greatest(F.lit(context) - n, F.lit(0))
        fill = F.array_repeat(F.lit(pad), rest)
        mask = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i >= F.size(r["p"]), 1.0).otherwise(0.0))
        return F.struct(
            F.concat(F.slice(whole, F.lit(1), n), fill).alias("x"),
            F.concat(F.slice(whole, F.lit(2), n), fill).alias("y"),
            F.concat(mask, F.array_repeat(F.lit(0.0), rest)).alias("mask"),
        )

    keep = F.greatest(F.lit(1), F.lit(size) - F.size(answer))
    left = F.when(F.size(prompt) + F.size(answer) > size, F.slice(prompt, F.greatest(F.size(prompt) - keep, F.lit(0)) + 1, keep)).otherwise(prompt)
    return let(let(left, cut_answer), build)


# Prompts.
_FROM_EVIDENCE = "要求: 根拠に含まれる情報だけを使い、対象が何をするものかを一文で簡潔に説明してください。根拠にない内容は追加しないでください"
_FROM_KNOWLEDGE = "要求: action・target・purpose を学習済み知識から推定し、対象の機能を簡潔に説明してください"
_FROM_STRUCTURE = "要求: この機能構造に対応する学習済みの説明を簡潔に答えてください"


def _lines(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def concept_prompts(concept: Column, relation: Column) -> Column:
    """The two prompts of a concept under a relation."""
    long = _lines("概念: ", concept, "\n関係: ", relation, "\n要求: この概念について、学習済みの内容だけを使って簡潔に説明してください")
    return F.array(long, _lines("主語=", concept, " / 関係=", relation, "\nこの関係に対応する説明を回答してください"))


def role_prompts(subject: Column, relation: Column) -> Column:
    """The long and the compact prompt of a role."""
    long = _lines("主語: ", subject, "\n意味役割: ", relation, "\n要求: 学習済みの内容だけを使って、この役割に対応する説明を簡潔に答えてください")
    return F.array(long, _lines("subject=", subject, " relation=", relation, " -> ?"))


def evidence_queries(subject: Column) -> Column:
    """The three questions of the first pass, which name the subject alone."""
    s = collapse(subject)
    return F.array(*[F.concat(s, F.lit(tail)) for tail in ("とは", "は何をするものですか", "の役割は何ですか")])


def function_prompts(subject: Column, slots: Column) -> Column:
    """The long and the compact prompt of a function whose slots (action, target, purpose) are known."""
    a, t, p = slots["action"], slots["target"], slots["purpose"]
    long = _lines("主語: ", subject, "\n意味役割: function\naction: ", a, "\ntarget: ", t, "\npurpose: ", p, "\n" + _FROM_STRUCTURE)
    return F.array(long, _lines("subject=", subject, " function.action=", a, " function.target=", t, " function.purpose=", p, " -> ?"))


def inference_prompts(subject: Column) -> Column:
    """The same without slots."""
    s = collapse(subject)
    long = _lines("主語: ", s, "\n意味役割: function\naction: ?\ntarget: ?\npurpose: ?\n" + _FROM_KNOWLEDGE)
    return F.array(long, _lines("subject=", s, " relation=function function.action=? function.target=? function.purpose=? -> ?"))


def compose_prompt(subject: Column, evidence: Column, slots: Column) -> Column:
    """The prompt of the second pass, of evidence and its slots alone."""
    parts = ("\n意味役割: function\naction: ", slots["action"], "\ntarget: ", slots["target"], "\npurpose: ", slots["purpose"], "\n根拠: ", collapse(evidence))
    return _lines("主語: ", collapse(subject), *parts, "\n" + _FROM_EVIDENCE)
