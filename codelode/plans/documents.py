"""Queries over documents, embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions import text as T
from codelode.operators import keywords as K
from codelode.operators import maintenance as M
from codelode.operators import retrieval as R
from codelode.sources.tables import table

from .registry import listed, query

ASKED = "How does the worker schedule retry batches when the queue is locked and the index returns an error?"
STOP = listed(fixed.STOP_WORDS)
TOP_WORDS = f"""
tokens as (select doc_id, unnest(ws) as keyword, generate_subscripts(ws, 1) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') as ws from documents)),
counted as (select doc_id, keyword, count(*) as tf, min(pos) as fst from tokens where keyword not in ({STOP}) group by doc_id, keyword),
top as (select doc_id, keyword, tf, row_number() over (partition by doc_id order by tf desc, fst) as rank from counted qualify rank <= 20)"""
TERMS = f"""
asked as (select unnest(ws) as keyword, generate_subscripts(ws, 1) as pos from (select regexp_extract_all(lower('{ASKED}'), '[a-z]{{3,}}') as ws)),
terms as (select keyword from (select keyword, count(*) as tf, min(pos) as fst from asked where keyword not in ({STOP}) group by keyword) order by tf desc, fst limit 10)"""
SCORES = (
    TOP_WORDS
    + ","
    + TERMS
    + """,
hits as (select t.keyword, t.doc_id from top t join terms using (keyword)),
weights as (select keyword, ln(((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) as w from hits group by keyword),
scores as (select doc_id, sum(w) as score from hits join weights using (keyword) group by doc_id)"""
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(f"with {TOP_WORDS} select doc_id, keyword, tf, rank from top")
def keywords_topn(spark, folder):
    return K.top_keywords(documents(spark, folder), ["doc_id"], "text")


@query(f"with {TOP_WORDS} select keyword, count(*) as df from top group by keyword")
def inverted_index_df(spark, folder):
    return K.inverted_index(documents(spark, folder), ["doc_id"], "text").groupBy("keyword").agg(F.count("*").alias("df"))


def _scores(spark, folder):
    docs = documents(spark, folder)
    terms = K.query_terms(docs, ASKED)
    total = docs.agg(F.count("*").alias("n"))
    return K.idf_scores(K.postings_of(docs, ["doc_id"], "text", terms), ["doc_id"], total), terms, total


@query(f"with {SCORES} select doc_id, round(score, 6) as score from scores where round(score, 6) >= 0.2 order by round(score, 6) desc, doc_id limit 5")
def idf_search(spark, folder):
    scores = _scores(spark, folder)[0].withColumn("score", F.round("score", 6))
    return K.ranked(scores, "doc_id")


@query(
    f"with {SCORES}, m as (select count(*) as ranked, coalesce(max(score), 0) as top from scores where score >= 0.2), "
    "n as (select (select count(*) from terms) as terms, (select count(*) from documents) as n) "
    "select ranked, round(top / (terms * ln(n + 1) + 5), 6) as ratio, "
    "case when top / (terms * ln(n + 1) + 5) >= 0.15 or (ranked >= 3 and top / (terms * ln(n + 1) + 5) >= 0.08) then 'high' "
    "when top / (terms * ln(n + 1) + 5) >= 0.05 or ranked >= 2 then 'medium' else 'low' end as confidence from m, n"
)
def confidence_label(spark, folder):
    scores, terms, total = _scores(spark, folder)
    none = spark.createDataFrame([], "x int")
    one = R.confidence_inputs(scores, terms, total, none)
    return one.select("ranked", F.round("ratio", 6).alias("ratio"), T.confidence(F.col("hits"), F.col("ranked"), F.col("ratio")).alias("confidence"))


@query(
    "with l as (select doc_id, unnest(ls) as line_text, generate_subscripts(ls, 1) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where contains(lower(text), 'queue'))) "
    "select doc_id, cast(line as bigint) as line, trim(line_text, ' ') as content from l where contains(lower(line_text), 'queue') order by doc_id, line limit 50"
)
def grep_lines(spark, folder):
    return R.search_lines(documents(spark, folder), ["doc_id"], "queue")


@query(
    "with l as (select doc_id, unnest(ls) as line_text, generate_subscripts(ls, 1) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where contains(lower(text), 'queue'))) "
    "select kind, count(*) as lines, count(distinct doc_id) as docs from l join documents using (doc_id) where contains(lower(line_text), 'queue') group by kind"
)
def grep_counts(spark, folder):
    """All hits of a literal search, counted by kind of document."""
    docs = documents(spark, folder)
    some = docs.where(F.contains(F.lower("text"), F.lit("queue"))).select("doc_id", "kind", F.explode(T.plain_lines(F.col("text"))).alias("l"))
    return some.where(F.contains(F.lower("l"), F.lit("queue"))).groupBy("kind").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("docs"))


@query(
    "with p as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null) "
    "select doc_id, 0 as chunk_index, 1 as start_line, cast(least(len(ls), 200) as int) as end_line, array_to_string(ls[1:200], chr(10)) as content from p"
)
def chunk_plain(spark, folder):
    ls = T.plain_lines(F.col("text"))
    rows = documents(spark, folder).where("text is not null").withColumn("ls", ls)
    return rows.select(
        "doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.least(F.size("ls"), F.lit(fixed.PLAIN_LINES)).alias("end_line"),
        F.array_join(F.slice("ls", 1, fixed.PLAIN_LINES), "\n").alias("content"),
    )


@query(
    "with d as (select project_id, doc_id, length(text) as n from documents where text is not null) "
    "select project_id, doc_id, cast(n as bigint) as chars, cast(sum(n) over (partition by project_id order by doc_id rows unbounded preceding) as bigint) as used from d "
    "qualify sum(n) over (partition by project_id order by doc_id rows unbounded preceding) <= 24000"
)
def context_pack_running(spark, folder):
    rows = documents(spark, folder).where("text is not null").select("project_id", "doc_id", F.length("text").cast("bigint").alias("chars"))
    return R.running_context(rows, ["project_id"], ["doc_id"], F.col("chars"))


@query(
    "with q as (select list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id = 0) "
    "select vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), q), 6) as sim from embeddings, q "
    "order by round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), q), 6) desc, vec_id limit 10"
)
def vector_topk(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = rows.where("vec_id = 0").select(F.col("vector").alias("q"))
    scored = rows.crossJoin(F.broadcast(q.limit(1))).select("vec_id", F.round(R.dot(F.col("vector"), F.col("q")), 6).alias("sim"))
    return scored.orderBy(F.desc("sim"), "vec_id").limit(fixed.VECTOR_HITS)


@query(
    "with q as (select list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id = 0), "
    "s as (select label, vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), q), 6) as sim from embeddings, q) "
    "select label, vec_id, sim, row_number() over (partition by label order by sim desc, vec_id) as rank from s qualify rank <= 3"
)
def vector_topk_per_label(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    q = rows.where("vec_id = 0").select(F.col("vector").alias("q"))
    scored = rows.crossJoin(F.broadcast(q.limit(1))).select("label", "vec_id", F.round(R.dot(F.col("vector"), F.col("q")), 6).alias("sim"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("sim"), "vec_id"))
    return scored.withColumn("rank", rank.cast("bigint")).where("rank <= 3")


SESSIONS = "log as (select user_id, event_id, event_type as question, props as answer, row_number() over (partition by user_id order by ts, event_id) - 1 as turn_index from events)"


def sessions(spark, folder) -> DataFrame:
    """Events read as a session log: one session a user, turns in order of time."""
    rows = table(spark, folder, "events")
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select("user_id", "event_id", F.col("event_type").alias("question"), F.col("props").alias("answer"), turn.cast("bigint").alias("turn_index"))


@query(f"with {SESSIONS} select user_id, event_id, turn_index from log qualify row_number() over (partition by user_id order by turn_index desc) <= 5")
def session_tail(spark, folder):
    return M.tail(sessions(spark, folder), "user_id", 5).select("user_id", "event_id", "turn_index")


@query(f"with {SESSIONS} select user_id, max(turn_index) + 1 as next_turn from log group by user_id")
def session_next_turn(spark, folder):
    return M.next_turn(sessions(spark, folder), "user_id")


@query(
    f"with {SESSIONS}, t as (select * from log qualify row_number() over (partition by user_id order by turn_index desc) <= 3) "
    "select user_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) order by turn_index) as block from t group by user_id"
)
def history_block(spark, folder):
    return M.history_block(sessions(spark, folder), "user_id", 3)


@query("select event_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, folder):
    """A key of the JSON text, null where it is none."""
    return table(spark, folder, "events").select("event_id", "event_type", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("select event_type, count(*) as n, cast(sum(try_cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(value) as most from events group by event_type")
def json_props_by_type(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') as bigint)"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("value").alias("most"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def upsert_keep_last(spark, folder):
    rows = table(spark, folder, "events").withColumn("_o", F.struct("ts", "event_id"))
    half = F.col("event_id") % 2 == 0
    return M.upsert(rows.where(half), rows.where(~half), ["user_id"], "_o").select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def dedupe_keep_first(spark, folder):
    return M.keep_first(table(spark, folder, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    "select lower(substr(lang, 1, 2)) as language, count(*) as docs, count(distinct project_id) as projects, cast(sum(length(text)) as bigint) as chars from documents group by 1"
)
def language_histogram(spark, folder):
    rows = documents(spark, folder).groupBy(F.lower(F.substring("lang", 1, 2)).alias("language"))
    return rows.agg(F.count("*").alias("docs"), F.countDistinct("project_id").alias("projects"), F.sum(F.length("text")).alias("chars"))


COMMENT = "(trim(regexp_replace(l, '[\\t\\r\\x0b\\x0c]', ' ', 'g')))"


@query(
    f"""select doc_id, left(array_to_string(list_filter(string_split(text, chr(10)), lambda l: {COMMENT} <> '' and not (starts_with({COMMENT}, '//') or starts_with({COMMENT}, '#')
    or starts_with({COMMENT}, '*') or starts_with({COMMENT}, '/*'))), chr(10)), 2000) as stripped from documents"""
)
def strip_and_truncate(spark, folder):
    return documents(spark, folder).select("doc_id", F.left(T.without_comments(F.col("text")), F.lit(2000)).alias("stripped"))


@query(
    "select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case when i < 10000 then lpad(cast(i as varchar), 4, ' ') else cast(i as varchar) end || ' | ' || l), chr(10)) as numbered from documents"
)
def numbered_lines(spark, folder):
    return documents(spark, folder).select("doc_id", T.numbered(F.col("text")).alias("numbered"))


@query(
    "select doc_id, "
    + " or ".join(f"contains(lower(text), '{w}')" for w in fixed.AGGREGATE_WORDS)
    + " as aggregate, "
    + " or ".join(f"contains(lower(text), '{w}')" for w in fixed.OVERVIEW_WORDS)
    + " as overview, coalesce("
    + ", ".join(f"case when contains(lower(text), '{w}') then '{c}' end" for w, c in fixed.CATEGORY_WORDS)
    + ") as category from documents where kind = 'question'"
)
def question_flags(spark, folder):
    t = F.col("text")
    rows = documents(spark, folder).where("kind = 'question'")
    return rows.select("doc_id", T.is_aggregate_question(t).alias("aggregate"), T.is_overview_question(t).alias("overview"), T.category_asked_for(t).alias("category"))


@query("select doc_id, case when length(text) > 0 then (length(text) - length(replace(text, chr(65533), ''))) / length(text) else 0.0 end as share from documents where text is not null")
def replacement_share(spark, folder):
    return documents(spark, folder).where("text is not null").select("doc_id", T.replacement_share(F.col("text")).alias("share"))


@query("select kind, doc_id, cast(length(text) as bigint) as chars, row_number() over (partition by kind order by length(text) desc, doc_id) as rank from documents where text is not null qualify rank <= 5")
def largest_docs(spark, folder):
    rows = documents(spark, folder).where("text is not null").select("kind", "doc_id", F.length("text").cast("bigint").alias("chars"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("chars"), "doc_id"))
    return rows.withColumn("rank", rank.cast("bigint")).where("rank <= 5")


@query(
    "select doc_id, trim(regexp_extract(text, '(?s)```(?:json|sh|py)?\\s*\\n(.*?)\\n?```', 1)) as block from documents where contains(text, '```')"
)
def fenced_blocks(spark, folder):
    """What stands in the first fenced block of a text."""
    rows = documents(spark, folder).where(F.contains("text", F.lit("```")))
    return rows.select("doc_id", F.trim(F.regexp_extract("text", r"(?s)```(?:json|sh|py)?\s*\n(.*?)\n?```", 1)).alias("block"))


@query(
    "with p as (select doc_id, project_id, length(text) as n from documents where text is not null) "
    "select project_id, count(*) as docs, cast(sum(n) as bigint) as chars, cast(max(n) as bigint) as longest, count(*) filter (n = 0) as empty from p group by project_id"
)
def document_totals(spark, folder):
    n = F.length("text")
    rows = documents(spark, folder).where("text is not null").groupBy("project_id")
    return rows.agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.max(n).cast("bigint").alias("longest"), F.count_if(n == 0).alias("empty"))


@query(f"with {TOP_WORDS} , n as (select kind, keyword, count(*) as docs from (select doc_id, keyword from top) join (select doc_id, kind from documents) using (doc_id) group by kind, keyword) select kind, keyword, docs, row_number() over (partition by kind order by docs desc, keyword) as rank from n qualify rank <= 20")
def keywords_by_kind(spark, folder):
    docs = documents(spark, folder)
    words = K.top_keywords(docs, ["doc_id", "kind"], "text").groupBy("kind", "keyword").agg(F.count("*").alias("docs"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("docs"), "keyword"))
    return words.withColumn("rank", rank.cast("bigint")).where("rank <= 20")
