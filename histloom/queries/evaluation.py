"""Queries on model answers and scores. Answers are built from documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from histloom.functions import model_output as M
from histloom.functions import nested as N
from histloom.functions import vectors as V
from histloom.functions.text import first_tagged, last_tagged
from histloom.operators.lookups import each
from histloom.plans import evaluation as E
from histloom.queries import sql as S
from histloom.queries.registry import query, table, texts


def answers(spark, sf):
    """Model answers on documents: traits that quote the document, fenced or bare, some broken.
    The excerpts are the thirds of the document, the description is all of it."""
    text = F.col("text")
    third = F.floor(F.length(text) / 3).cast("int")

    def quote(part, at):
        return F.struct(part.alias("quote"), F.lit(at).alias("source_index"))

    def trait(name, *quotes):
        return F.struct(F.lit(name).alias("trait"), F.lit(0.5).alias("confidence"), F.array(*quotes).alias("evidence_quotes"))

    def cut(a, n):
        a = F.lit(a) if isinstance(a, int) else F.greatest(a, F.lit(1))
        return F.substring(text, a, F.lit(n) if isinstance(n, int) else n)

    body = F.to_json(
        F.struct(
            F.array(
                trait("one", quote(cut(third - 24, 20), 0), quote(cut(third - 10, 30), 0)),
                trait("two", quote(cut(1, 8), 0), quote(F.lit(" Security "), -1)),
                trait("three", quote(cut(F.length(text) - 24, 25), 2), quote(cut(F.length(text) - 24, 25), 9)),
            ).alias("traits"),
            text.alias("persona_description"),
        )
    )
    kind = F.col("doc_id") % 10
    raw = (
        F.when(kind == 0, F.concat(F.lit("{"), body))
        .when(kind < 4, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind < 7, F.concat(F.lit("Here "), body, F.lit(" end")))
        .otherwise(body)
    )
    return texts(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("user_id"),
        F.array(cut(1, third), cut(third + 1, third), cut(third * 2 + 1, F.length(text))).alias("excerpts"),
        raw.alias("raw"),
    )


def _norm(x):
    return f"lower({S.squeeze(x)})"


def _grounding_sql(with_names):
    named = "1" if with_names else "0"
    return f"""
cuts as (select doc_id, "text", length("text") n, length("text") // 3 k from documents),
ex as (select doc_id, {_norm('substr("text", 1, k)')} e0, {_norm('substr("text", 2 * k + 1)')} e2,
  {_norm('substr("text", greatest(k - 24, 1), 20)')} q1, {_norm('substr("text", greatest(k - 10, 1), 30)')} q2,
  {_norm('substr("text", greatest(n - 24, 1), 25)')} q5 from cuts),
flags as (select doc_id, length(q1) >= 12 c1, length(q2) >= 12 c2, length(q5) >= 12 c5,
  length(q1) >= 12 and contains(e0, q1) v1, length(q2) >= 12 and contains(e0, q2) v2,
  length(q5) >= 12 and contains(e2, q5) v5 from ex),
sums as (select doc_id, c1::INT + c2::INT + 2 * c5::INT + {named} total, v1::INT + v2::INT + v5::INT + {named} good,
  (v1 or v2)::INT + v5::INT + {named} covered from flags),
scores as (select doc_id user_id, case when doc_id % 10 = 0 or total = 0 then 0.0
  else 0.5 * good / total + 0.5 * covered / 3 end::DOUBLE grounding from sums)"""


@query("grounding_score", f"with {_grounding_sql(False)} select user_id, round(grounding, 6) grounding from scores")
def grounding_score(spark, sf):
    rows = E.with_grounding(M.with_traits(answers(spark, sf), "raw"), "traits", "excerpts", "grounding")
    return rows.select("user_id", F.round("grounding", 6).alias("grounding"))


@query("grounding_score_values", f"with {_grounding_sql(True)} select user_id, round(grounding, 6) grounding from scores")
def grounding_score_values(spark, sf):
    rows = E.with_grounding(M.with_traits(answers(spark, sf), "raw"), "traits", "excerpts", "grounding", True)
    return rows.select("user_id", F.round("grounding", 6).alias("grounding"))


@query(
    "parse_traits",
    """select doc_id user_id, (i - 1)::INT pos, ['one', 'two', 'three'][i] trait, "text" persona_description
    from documents, range(1, 4) t(i) where doc_id % 10 <> 0""",
)
def parse_traits(spark, sf):
    rows = M.with_traits(answers(spark, sf), "raw")
    return each(rows, "traits", ["user_id", "persona_description"], item="t").select(
        "user_id", "pos", "t.trait", "persona_description"
    )


def outputs(spark, sf):
    """Answers with an alignment score; every eighth failed."""
    rows = answers(spark, sf).filter("user_id % 8 <> 3")
    return rows.select("user_id", "raw", ((F.col("user_id") % 5) / 4).alias("alignment"))


_EVAL = f"""{_grounding_sql(False)}, evals as (
  select user_id, "text" t, case when user_id % 8 = 3 then 0.0 else grounding end::DOUBLE grounding,
         case when user_id % 8 = 3 then 0.0 else 0.5 * grounding + 0.5 * (user_id % 5) / 4 end::DOUBLE score
  from scores join documents on doc_id = user_id)"""


@query(
    "evaluate_batch",
    f"with {_EVAL} select user_id, round(grounding, 6) grounding, round(score, 6) score, case when user_id % 8 = 3 or user_id % 10 = 0 then '' else t end persona_description from evals",
)
def evaluate_batch(spark, sf):
    scored = E.evaluate(answers(spark, sf).select("user_id", "excerpts"), outputs(spark, sf))
    return scored.select(
        "user_id", F.round("grounding", 6).alias("grounding"), F.round("score", 6).alias("score"), "persona_description"
    )


@query(
    "worst_traces",
    f"""with {_EVAL} select user_id, case when user_id % 8 = 3 or user_id % 10 = 0 then '' else t end as generated,
    printf('Evaluation Score: %.3f. Diagnosis: none', score) feedback, score from (select * replace (round(score, 6) as score) from evals)
    order by score, user_id limit 8""",
)
def worst_traces(spark, sf):
    scored = E.evaluate(answers(spark, sf).select("user_id", "excerpts"), outputs(spark, sf))
    return E.worst_traces(scored.withColumn("score", F.round("score", 6)), "user_id", 8)


def verdicts(spark, sf):
    """Verdict texts from customer numbers; some verdicts are missing, some have reasoning."""
    key = F.col("c_custkey")

    def word(i):
        return F.when(key % (i + 2) == 0, "yes").otherwise("No")

    short = F.concat_ws("\n", *[F.when(key % (i + 6) != 0, F.concat(F.lit(f"{i}: "), word(i))) for i in range(1, 5)])
    said = F.when(key % 4 == 0, F.lit(". Plain. Verdict: ")).otherwise(F.lit(". It is not clear. Verdict: "))
    long = F.concat_ws("\n", *[F.concat(F.lit(str(i)), said, word(i)) for i in range(1, 6)])
    return table(spark, sf, "customer").select("c_custkey", short.alias("short"), long.alias("long"))


def _yes(i, missing=None):
    said = f"(c_custkey % {i + 2} = 0)::INT"
    return said if missing is None else f"case when c_custkey % {i + 6} = 0 then {missing} else {said} end"


@query(
    "verdict_score4",
    f"select c_custkey, (({_yes(2, 0)} + {_yes(4, 0)} - {_yes(1, 1)} - {_yes(3, 1)} + 2) / 4)::DOUBLE score from customer",
)
def verdict_score4(spark, sf):
    return verdicts(spark, sf).select("c_custkey", M.verdict_score4(F.col("short")).alias("score"))


@query(
    "verdict_score5",
    f"""select c_custkey, score, case when c_custkey % 4 = 0 then score else 0.4 end::DOUBLE loose from (
      select c_custkey, (({_yes(2)} + {_yes(4)} + {_yes(5)} - {_yes(1)} - {_yes(3)} + 2) / 5)::DOUBLE score from customer)""",
)
def verdict_score5(spark, sf):
    return verdicts(spark, sf).select(
        "c_custkey",
        M.verdict_score5(F.col("long")).alias("score"),
        M.verdict_score5(F.col("long"), loose=True).alias("loose"),
    )


def tagged(spark, sf):
    """Each half of a document in tags; every fourth document has none."""
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    both = F.concat(
        F.lit("pre <d> "), F.left(text, half), F.lit("</d> mid <d>"), F.substring(text, half + 1, F.length(text)), F.lit(" </d>")
    )
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, text).otherwise(both).alias("t")
    )


@query(
    "tag_first",
    f"""select doc_id, {S.strip('case when doc_id % 4 = 0 then "text" else left("text", length("text") // 2) end')} as value from documents""",
)
def tag_first(spark, sf):
    return tagged(spark, sf).select("doc_id", first_tagged(F.col("t"), "d").alias("value"))


@query(
    "tag_last",
    f"""select doc_id, {S.strip('case when doc_id % 4 = 0 then "text" else substr("text", length("text") // 2 + 1) end')} as value from documents""",
)
def tag_last(spark, sf):
    return tagged(spark, sf).select("doc_id", last_tagged(F.col("t"), "d").alias("value"))


@query(
    "parse_json_greedy",
    "select c_custkey, case when c_custkey % 6 <> 0 then c_mktsegment end segment, case when c_custkey % 6 <> 0 then c_nationkey::VARCHAR end nation from customer",
)
def parse_json_greedy(spark, sf):
    body = F.to_json(F.struct("c_mktsegment", "c_nationkey"))
    bad = F.when(F.col("c_custkey") % 6 == 0, "{oops ").otherwise("")
    text = F.concat(F.lit("I think\n"), bad, body, F.lit("\nis it."))
    rows = table(spark, sf, "customer").select("c_custkey", M.json_in_text(text).alias("m"))
    return rows.select("c_custkey", N.get(F.col("m"), "c_mktsegment").alias("segment"), N.get(F.col("m"), "c_nationkey").alias("nation"))


@query(
    "parse_list",
    """select c_custkey, i::INT - 1 pos, case i when 1 then c_name when 2 then c_mktsegment end goal
    from customer, range(1, 3) t(i) where c_custkey % 6 <> 0""",
)
def parse_list(spark, sf):
    body = F.to_json(F.array("c_name", "c_mktsegment", F.lit("third")))
    close = F.when(F.col("c_custkey") % 6 == 0, "").otherwise("\n```")
    text = F.concat(F.lit("Goals:\n```json\n"), body, close)
    return each(table(spark, sf, "customer"), M.list_in_text(text, 2), ["c_custkey"], item="goal")


@query(
    "code_blocks",
    """select conv_id, turn, pos::INT pos, case pos when 0 then 'python' else '' end as language,
    case pos when 0 then "text" || chr(10) else 'ls -l' || chr(10) end code
    from conversations, range(0, 2) t(pos)""",
)
def code_blocks(spark, sf):
    text = F.concat(F.lit("Run ```python\n"), F.col("text"), F.lit("\n``` then\n```\nls -l\n``` ok"))
    return each(table(spark, sf, "conversations"), M.code_blocks(text), ["conv_id", "turn"], item="b").select(
        "conv_id", "turn", "pos", "b.language", "b.code"
    )


def surveys(spark, sf):
    """Surveys from customers: JSON with nested sections, plain text, or none."""
    key = F.col("c_custkey")
    inner = F.struct(
        F.struct(F.col("c_name").alias("Name"), F.col("c_nationkey").cast("string").alias("Nation")).alias("Demographic Information"),
        F.struct(F.struct(F.lit("often").alias("Online")).alias("Channel"), F.col("c_mktsegment").alias("Segment")).alias("Shopping Preference"),
        F.lit("calm").alias("Personality"),
    )
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.lit(None)).otherwise(F.to_json(inner)).alias("survey")
    )


@query(
    "survey_parse",
    """select c_custkey, case when c_custkey % 4 = 0 then 1 when c_custkey % 4 > 1 then 3 else -1 end::INT fields,
    case when c_custkey % 4 = 0 then c_name end raw from customer""",
)
def survey_parse(spark, sf):
    rows = surveys(spark, sf).select("c_custkey", N.survey_fields(F.col("survey")).alias("s"))
    return rows.select("c_custkey", F.coalesce(F.size("s"), F.lit(-1)).alias("fields"), N.get(F.col("s"), "raw_survey").alias("raw"))


@query(
    "survey_text",
    """select c_custkey, case when c_custkey % 4 = 1 then '' when c_custkey % 4 = 0 then
      concat_ws(chr(10), '### Survey Information', '', '**Survey Data:**', c_name) else
      concat_ws(chr(10), '### Survey Information', '', '**Demographics:**', '- Name: ' || c_name, '- Nation: ' || c_nationkey,
      '', '**Shopping Preferences:**', '- Channel:', '  - Online: often', '- Segment: ' || c_mktsegment, '', '**Personality:**', '- calm') end as text
    from customer""",
)
def survey_text(spark, sf):
    rows = surveys(spark, sf).withColumn("s", N.survey_fields(F.col("survey")))
    return rows.select("c_custkey", N.survey_text(F.col("s")).alias("text"))


_LOGITS = "list_transform(embedding[1:3], lambda x: x::DOUBLE)"
_SOFTMAX = f"exp({_LOGITS}[3]) / list_sum(list_transform({_LOGITS}, lambda x: exp(x)))"


def logits(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", "label", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("logits"))


@query("softmax_pick", f"select vec_id, round({_SOFTMAX}, 6) p from embeddings")
def softmax_pick(spark, sf):
    return logits(spark, sf).select("vec_id", F.round(V.softmax_at(F.col("logits"), 2), 6).alias("p"))


@query(
    "score_gate",
    f"select vec_id, case when p < 0.3 then p else label / 10 end::DOUBLE score from (select vec_id, label, round({_SOFTMAX}, 6) p from embeddings)",
)
def score_gate(spark, sf):
    rows = logits(spark, sf).withColumn("p", F.round(V.softmax_at(F.col("logits"), 2), 6))
    return rows.select("vec_id", V.gated_score(F.col("p"), F.col("label") / 10).alias("score"))


@query(
    "combined_score",
    """select event_id, round(0.5 * ("value" / 500) + 0.5 * (event_id % 3) / 2, 6) grounded_alignment,
    round(0.7 * greatest(0, 1 - 0.25 * (event_id % 6)) + 0.3 * ("value" / 500), 6)::DOUBLE faithful_coverage from events""",
)
def combined_score(spark, sf):
    g, key = F.col("value") / 500, F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.round(V.grounded_alignment(g, (key % 3) / 2), 6).alias("grounded_alignment"),
        F.round(V.faithful_coverage(V.faithfulness(key % 6), g), 6).alias("faithful_coverage"),
    )


@query(
    "pair_features",
    """with u as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) e from embeddings),
    n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from u)
    select a.vec_id, (i - 1)::INT pos, round(a.e[i] * b.e[i], 6) + 0.0::DOUBLE x
    from n a join n b on b.vec_id = a.vec_id + 1, range(1, 65) t(i)""",
)
def pair_features(spark, sf):
    rows = texts(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", V.unit(F.col("embedding")).alias("e"))
    item = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("item"))
    features = V.pair_features(F.col("e"), F.col("item"))
    return each(rows.join(item, "vec_id"), features, ["vec_id"], item="x").withColumn("x", F.round("x", 6) + 0.0)
