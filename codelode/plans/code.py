"""Queries over files, chunks, symbols and imports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions import text as T
from codelode.operators import analytics as A
from codelode.operators import code as C
from codelode.operators import maintenance as M
from codelode.operators import manifests as N
from codelode.operators import retrieval as R
from codelode.sources.tables import file_texts, table, valid_chunks, valid_files, valid_imports, valid_symbols

from . import invented as X
from .registry import CHUNKS, FILES, LINES, TEXTS, escaped, listed, query

PROJECT = "atlas-core"  # the project that hybrid_search and context_pack_fold search; a project is the unit of a search
ASKED = "encode worker batch from the queue index and verify channel"
SYMBOLS = "symbols_v as (select distinct * from symbols)"
IMPORTS = "imports_v as (select distinct * from file_imports)"
SEGMENTS = "list_transform(string_split(rel_path, '/'), lambda s: lower(s))"
NAME = "regexp_extract(rel_path, '[^/]*$')"
STOP = listed(fixed.STOP_WORDS)


def has_any(names) -> str:
    return f"list_has_any({SEGMENTS}, [{listed(names)}])"


def texts(spark, folder):
    return file_texts(table(spark, folder, "chunks"))


IS_TEST = f"({has_any(fixed.TEST_DIRS)} or contains(lower({NAME}), 'test_') or contains(lower(rel_path), '.test.') or contains(lower(rel_path), '.spec.') or contains(lower(rel_path), '_test.'))"


def _symbol_sql() -> str:
    cases = []
    for ext, patterns in fixed.SYMBOL_PATTERNS.items():
        found = ", ".join(
            f"case when regexp_extract(l, '{escaped(p)}', {re.compile(p).groupindex['name']}) <> '' then {{'name': regexp_extract(l, '{escaped(p)}', {re.compile(p).groupindex['name']}), 'type': '{kind}'}} end"
            for p, kind in patterns
        )
        cases.append(f"when ext = '{ext}' then coalesce({found})")
    return "case " + " ".join(cases) + " end"


FOUND = f"""{LINES},
each as (select project_id, rel_path, ext, unnest(ls) as l, generate_subscripts(ls, 1) as line from lines where ext in ({listed(fixed.SYMBOL_PATTERNS)})),
found as (select project_id, rel_path, cast(line as int) as line, {_symbol_sql()} as s from each)"""


@query(f"with {FOUND} select project_id, rel_path, s.name as name, s.type as type, line from found where s is not null")
def symbols_regex(spark, folder):
    return C.extract_symbols(texts(spark, folder))


@query(
    f"""with {FOUND},
sy as (select project_id, rel_path, s.name as name, line, lead(line) over (partition by project_id, rel_path order by line, s.name) as nxt from found where s is not null),
fi as (select project_id, rel_path, min(line) as first from sy group by project_id, rel_path),
head as (select project_id, rel_path, 1 as start_line, case when first is null then least(len(ls), 200) else first - 1 end as end_line, null as symbol_name, ls, 0 as part
  from lines left join fi using (project_id, rel_path) where first is null or first > 1),
body as (select project_id, rel_path, line as start_line, least(coalesce(nxt - 1, len(ls)), line + 59, len(ls)) as end_line, name as symbol_name, ls, 1 as part from lines join sy using (project_id, rel_path)),
both_ as (select * from head union all select * from body)
select project_id, rel_path, cast(row_number() over (partition by project_id, rel_path order by part, start_line, symbol_name) - 1 as int) as chunk_index, cast(start_line as int) as start_line,
  cast(end_line as int) as end_line, case when end_line < start_line then '' else array_to_string(ls[start_line:end_line], chr(10)) end as content, symbol_name from both_"""
)
def chunk_windows(spark, folder):
    t = texts(spark, folder)
    return C.chunk_texts(t, C.extract_symbols(t))


def _imports_sql() -> str:
    cases = []
    for ext, patterns in fixed.IMPORT_PATTERNS.items():
        found = " || ".join(f"regexp_extract_all(text, '{escaped(p)}', 1)" for p in patterns)
        cases.append(f"when ext = '{ext}' then {found}")
    return "case " + " ".join(cases) + " end"


IMPORTED = f"""{TEXTS},
named as (select project_id, rel_path, ext, unnest({_imports_sql()}) as imported_name from texts where text is not null),
imported as (select distinct project_id, rel_path, ext, imported_name from named)"""


@query(f"with {IMPORTED} select project_id, rel_path, imported_name from imported")
def imports_found(spark, folder):
    return C.extract_imports(texts(spark, folder)).drop("at")


@query(
    f"""with {IMPORTED}, {FILES},
py as (select project_id, rel_path, imported_name, replace(imported_name, '.', '/') || s as target_path, o from imported, (values ('.py', 0), ('/__init__.py', 1), ('', 2)) v(s, o) where ext = '.py'),
js as (select project_id, rel_path, imported_name, array_to_string(list_filter(string_split(case when contains(rel_path, '/') then regexp_extract(rel_path, '^(.*)/[^/]*$', 1) || '/' else '' end || imported_name, '/'),
    lambda x: x <> '' and x <> '.'), '/') || s as target_path, o
  from imported, (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('/index.ts', 5), ('/index.tsx', 6), ('/index.js', 7)) v(s, o) where ext <> '.py' and starts_with(imported_name, '.')),
hit as (select c.* from (select * from py union all select * from js) c semi join files_v f on c.project_id = f.project_id and c.target_path = f.rel_path),
best as (select project_id, rel_path, imported_name, min_by(target_path, o) as target_path from hit group by all)
select project_id, rel_path as source_path, imported_name, target_path from imported left join best using (project_id, rel_path, imported_name)"""
)
def imports_resolved(spark, folder):
    found = C.extract_imports(texts(spark, folder)).drop("at")
    return C.resolve_imports(found, valid_files(spark, folder))


CATEGORY = f"""
cat as (
  select project_id, rel_path, name as symbol_name, unnest([
    case when {has_any(fixed.DTO_DIRS)} or regexp_matches(lower(name), '(?:{"|".join(fixed.DTO_NAMES)})$') then 'dto' end,
    case when {has_any(fixed.TEST_DIRS)} or starts_with(lower(rel_path), 'test_') or contains(lower(rel_path), '.test.') or contains(lower(rel_path), '.spec.') then 'test' end,
    case when {has_any(fixed.SERVICE_DIRS)} or ends_with(lower(name), 'service') then 'service' end,
    case when {has_any(fixed.CONFIG_DIRS)} then 'config' end,
    case when {has_any(fixed.MIDDLEWARE_DIRS)} then 'middleware' end]) as category, 'type=' || type as detail
  from symbols_v)"""


@query(f"with {SYMBOLS}, {CATEGORY} select * from cat where category is not null")
def symbol_categories(spark, folder):
    return C.categories(valid_symbols(spark, folder))


@query(
    f"""with {SYMBOLS}, {TEXTS},
rf as (select project_id, rel_path from texts where {has_any(fixed.ROUTE_DIRS)} or {" or ".join(f"coalesce(regexp_matches(text, '{p}'), false)" for p in fixed.ROUTE_TEXTS)}),
mine as (select s.* from symbols_v s semi join rf using (project_id, rel_path)),
fn as (select project_id, rel_path, name as symbol_name, 'route' as category, 'line=' || cast(coalesce(line, 0) as varchar) as detail from mine where type in ('function', 'method')),
rest as (select m.* from mine m anti join fn using (project_id, rel_path)),
one as (select project_id, rel_path, min_by(name, (line, name)) as symbol_name, 'route' as category, 'file-level' as detail from rest group by project_id, rel_path)
select * from fn union all select * from one"""
)
def route_categories(spark, folder):
    return C.route_categories(texts(spark, folder), valid_symbols(spark, folder))


@query(f"with {SYMBOLS}, {CATEGORY} select project_id, category, count(*) as symbols, count(distinct rel_path) as files from cat where category is not null group by project_id, category")
def category_counts(spark, folder):
    """A18."""
    return C.categories(valid_symbols(spark, folder)).groupBy("project_id", "category").agg(F.count("*").alias("symbols"), F.countDistinct("rel_path").alias("files"))


@query(
    f"""with {SYMBOLS}, {CATEGORY}, k as (select project_id, category, rel_path, list(symbol_name order by symbol_name) as names from cat where category is not null
  and symbol_name not in ({listed(fixed.GENERIC_SYMBOLS)}) group by all)
select project_id, category, rel_path, array_to_string(names[1:10], ', ') || case when len(names) > 10 then ' (+' || cast(len(names) - 10 as varchar) || ' more)' else '' end as shown from k"""
)
def category_groups(spark, folder):
    """The symbols of each category and file, ten shown."""
    rows = C.categories(valid_symbols(spark, folder)).where(~F.col("symbol_name").isin(*fixed.GENERIC_SYMBOLS))
    names = rows.groupBy("project_id", "category", "rel_path").agg(F.array_sort(F.collect_list("symbol_name")).alias("n"))
    more = F.when(F.size("n") > 10, F.concat(F.lit(" (+"), (F.size("n") - 10).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return names.select("project_id", "category", "rel_path", F.concat(F.array_join(F.slice("n", 1, 10), ", "), more).alias("shown"))


TOP_WORDS = f"""
tokens as (select project_id, rel_path, unnest(ws) as keyword, generate_subscripts(ws, 1) as pos from (select project_id, rel_path, regexp_extract_all(lower(text), '[a-z]{{3,}}') as ws from texts)),
counted as (select project_id, rel_path, keyword, count(*) as tf, min(pos) as fst from tokens where keyword not in ({STOP}) group by all),
top as (select project_id, rel_path, keyword from counted qualify row_number() over (partition by project_id, rel_path order by tf desc, fst) <= 20)"""


def _atlas(rows, project=PROJECT):
    """The rows of the project that is searched."""
    return rows.where(F.col("project_id").startswith(project))


HYBRID = f"""{TEXTS.replace("from chunks_v group", f"from chunks_v where starts_with(project_id, '{PROJECT}') group")}, {TOP_WORDS},
asked as (select unnest(ws) as keyword, generate_subscripts(ws, 1) as pos from (select regexp_extract_all(lower('{ASKED}'), '[a-z]{{3,}}') as ws)),
terms as (select keyword from (select keyword, count(*) as tf, min(pos) as fst from asked where keyword not in ({STOP}) group by keyword) order by tf desc, fst limit 10),
hits as (select t.keyword, t.rel_path from top t join terms using (keyword)),
weights as (select keyword, ln(((select count(*) from texts) - count(*) + 0.5) / (count(*) + 0.5) + 1) as w from hits group by keyword),
ws as (select distinct unnest(string_split(lower('{ASKED}'), ' ')) as word),
sym as (select rel_path, 5.0 as w from (select distinct * from symbols where starts_with(project_id, '{PROJECT}')) s join ws on lower(s.name) = ws.word),
vec as (select vec_id, any_value(rel_path) as rel_path, any_value(list_transform(vector, lambda x: cast(x as double))) as v from chunk_vectors
  where starts_with(project_id, '{PROJECT}') and len(vector) = 384 and not list_bool_or(list_transform(vector, lambda x: isnan(x))) group by vec_id),
q as (select v as qv from vec order by vec_id limit 1),
sims as (select rel_path, vec_id, round(list_dot_product(v, qv), 9) as sim from vec, q order by round(list_dot_product(v, qv), 9) desc, rel_path, vec_id limit 10),
contributions as (select rel_path, w from hits join weights using (keyword) union all select rel_path, w from sym union all select rel_path, 3 * sim from sims where sim > 0.3),
scores as (select rel_path, sum(w) as score from contributions group by rel_path)"""


def _hits(spark, folder):
    rows = _atlas(table(spark, folder, "chunk_vectors")).where(F.size("vector") == 384)
    rows = rows.where(~F.isnan(F.array_max("vector"))).groupBy("vec_id").agg(F.first("rel_path").alias("rel_path"), F.first("vector").alias("vector"))
    q = rows.orderBy("vec_id").limit(1).select(F.col("vector").alias("q"))
    scored = rows.crossJoin(F.broadcast(q)).select("rel_path", "vec_id", F.round(R.dot(F.col("vector"), F.col("q")), 9).alias("sim"))
    return scored.orderBy(F.desc("sim"), "rel_path", "vec_id").limit(fixed.VECTOR_HITS)


@query(f"with {HYBRID} select rel_path, round(score, 6) as score from scores where round(score, 6) >= 0.2 order by round(score, 6) desc, rel_path limit 5")
def hybrid_search(spark, folder):
    t, s = _atlas(texts(spark, folder)), _atlas(valid_symbols(spark, folder))
    scores = R.hybrid_scores(t, s, ASKED, _hits(spark, folder)).withColumn("score", F.round("score", 6))
    return R.ranked(scores, "rel_path")


@query(
    f"""with recursive {HYBRID},
best as (select rel_path, row_number() over (order by round(score, 6) desc, rel_path) as file_rank from scores where round(score, 6) >= 0.2 order by file_rank limit 5),
parts as (select file_rank, chunk_index, '=== ' || rel_path || ' [lines ' || cast(start_line as varchar) || '-' || cast(end_line as varchar) || ']' ||
    case when coalesce(symbol_name, '') <> '' then ' (' || symbol_name || ')' else '' end || ' ===' || chr(10) || content as part
  from chunks_v join best using (rel_path) where starts_with(project_id, '{PROJECT}') and content is not null),
numbered as (select *, row_number() over (order by file_rank, chunk_index, part) as i from parts where part is not null),
fold as (select cast(0 as bigint) as i, cast(0 as bigint) as used, cast(-1 as bigint) as stopped, cast(0 as bigint) as n
  union all select m.i, case when f.stopped = m.file_rank or f.used >= 24000 or f.used + length(m.part) > 24000 then f.used else f.used + length(m.part) end,
    case when f.stopped = m.file_rank or f.used >= 24000 then f.stopped when f.used + length(m.part) > 24000 then m.file_rank else f.stopped end,
    case when f.stopped = m.file_rank or f.used >= 24000 or f.used + length(m.part) > 24000 then f.n else f.n + 1 end from fold f join numbered m on m.i = f.i + 1)
select cast(arg_max(used, i) as bigint) as used, cast(arg_max(n, i) as bigint) as parts from fold having max(i) > 0"""
)
def context_pack_fold(spark, folder):
    """The context of the five best files."""
    best = hybrid_search(spark, folder).withColumn("file_rank", F.row_number().over(W.orderBy(F.desc("score"), "rel_path"))).select("rel_path", "file_rank")
    chunks = _atlas(valid_chunks(spark, folder)).withColumn("one", F.lit(1)).where("start_line is not null and end_line is not null")
    packed = R.packed_context(best, chunks, ["one"])
    return packed.select(F.col("used").cast("bigint").alias("used"), F.col("parts").cast("bigint").alias("parts"))


@query(
    f"with {TEXTS}, l as (select project_id, rel_path, unnest(ls) as t, generate_subscripts(ls, 1) as line from (select project_id, rel_path, string_split(text, chr(10)) as ls from texts where contains(lower(text), 'ledger'))) "
    "select project_id, rel_path, cast(line as bigint) as line, trim(t, ' ') as content from l where contains(lower(t), 'ledger') order by project_id, rel_path, line limit 50"
)
def search_code(spark, folder):
    key, chunks = ["project_id", "rel_path"], table(spark, folder, "chunks")
    hit = chunks.where(F.contains(F.lower("content"), F.lit("ledger"))).select(*key).distinct()  # a line stands in one chunk
    return R.search_lines(file_texts(chunks.join(hit, key, "left_semi")), key, "Ledger")


@query(f"with {TEXTS} select project_id, rel_path, text, cast(length(text) as bigint) as chars from texts")
def file_contents(spark, folder):
    """The whole text of every file from its chunks."""
    return texts(spark, folder).withColumn("chars", F.length("text").cast("bigint"))


@query(f"with {FILES} select project_id, rel_path, ext, size_bytes, last_modified from files_v")
def list_files(spark, folder):
    """A27, T08."""
    return valid_files(spark, folder).select("project_id", "rel_path", "ext", "size_bytes", "last_modified")


MEASURES = f"""{FILES}, {CHUNKS}, {SYMBOLS},
cl as (select project_id, rel_path, coalesce(max(end_line), 0) as lines from chunks_v group by all),
sn as (select project_id, rel_path, count(distinct name) as symbols from symbols_v group by all),
measures as (select f.project_id, f.rel_path, f.ext, coalesce(f.size_bytes, 0) as size_bytes, coalesce(cl.lines, 0) as lines, coalesce(sn.symbols, 0) as symbols
  from files_v f left join cl using (project_id, rel_path) left join sn using (project_id, rel_path))"""


def measures(spark, folder):
    return A.file_measures(valid_files(spark, folder), valid_chunks(spark, folder), valid_symbols(spark, folder))


@query(f"with {FILES} select project_id, ext, count(*) as files, row_number() over (partition by project_id order by count(*) desc, ext) as rank from files_v where ext <> '' group by project_id, ext qualify rank <= 20")
def language_files(spark, folder):
    return A.languages(valid_files(spark, folder))


@query(
    f"with {FILES}, p as (select project_id, string_split(rel_path, '/') as s from files_v) "
    "select project_id, s[1] as top, null as sub, count(*) as files from p group by project_id, s[1] union all "
    "select project_id, s[1], s[2], count(*) from p where len(s) > 1 group by project_id, s[1], s[2]"
)
def directory_rollup(spark, folder):
    return A.directory_counts(valid_files(spark, folder)).select("project_id", "top", "sub", "files")


@query(
    f"with {MEASURES} select project_id, count(*) as total_files, cast(sum(lines) as bigint) as total_lines, cast(sum(size_bytes) as bigint) as total_size_bytes, cast(sum(symbols) as bigint) as total_symbols from measures group by project_id"
)
def complexity_totals(spark, folder):
    return A.totals(measures(spark, folder))


def _language_sql() -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.LANGUAGES.items())
    return f"case ltrim(ext, '.') {cases} else upper(ltrim(ext, '.')) end"


@query(
    f"with {MEASURES}, b as (select project_id, ext, cast(sum(lines) as bigint) as lines from measures group by project_id, ext) "
    "select project_id, ext, lines, cast(case when sum(lines) over (partition by project_id) > 0 then lines * 1000 // sum(lines) over (partition by project_id) else 0 end as bigint) as permille, "
    f"row_number() over (partition by project_id order by lines desc, ext) as rank, {_language_sql()} as language from b qualify rank <= 10"
)
def language_breakdown(spark, folder):
    return A.language_lines(measures(spark, folder))


def _top_sql(by: str) -> str:
    return f"with {MEASURES} select project_id, row_number() over (partition by project_id order by {by} desc, rel_path) as rank, rel_path, cast({by} as bigint) as {by} from measures qualify rank <= 5"


@query(_top_sql("size_bytes"))
def largest_files(spark, folder):
    return A.top_files(measures(spark, folder), "size_bytes")


@query(_top_sql("lines"))
def longest_files(spark, folder):
    return A.top_files(measures(spark, folder), "lines").withColumn("lines", F.col("lines").cast("bigint"))


@query(_top_sql("symbols"))
def most_complex_files(spark, folder):
    return A.top_files(measures(spark, folder), "symbols")


@query(f"with {CHUNKS} select project_id, max(end_line) as total_lines from chunks_v group by project_id")
def total_lines_legacy(spark, folder):
    """The greatest line number, not the sum."""
    return valid_chunks(spark, folder).groupBy("project_id").agg(F.max("end_line").alias("total_lines"))


@query(f"with {SYMBOLS} select project_id, type, count(*) as symbols from symbols_v group by project_id, type")
def symbols_by_type(spark, folder):
    return valid_symbols(spark, folder).groupBy("project_id", "type").agg(F.count("*").alias("symbols"))


@query(f"with {IMPORTS} select project_id, target_path, count(*) as imported_by, row_number() over (partition by project_id order by count(*) desc, target_path) as rank from imports_v where target_path is not null group by project_id, target_path qualify rank <= 10")
def import_fan_in(spark, folder):
    return A.fan_in(valid_imports(spark, folder))


@query(f"with {IMPORTS} select project_id, count(target_path) as internal, count(*) - count(target_path) as external from imports_v group by project_id")
def import_internal_external(spark, folder):
    """A16."""
    return valid_imports(spark, folder).groupBy("project_id").agg(F.count("target_path").alias("internal"), F.count_if(F.col("target_path").isNull()).alias("external"))


@query(f"with {IMPORTS} select source_path, imported_name, target_path, project_id from imports_v where imported_name ilike '%archive%'")
def imports_of(spark, folder):
    """S15."""
    return valid_imports(spark, folder).where(F.col("imported_name").ilike("%archive%"))


@query(
    f"with {IMPORTS}, e as (select distinct project_id, source_path, target_path from imports_v where target_path is not null), "
    "r as (select *, row_number() over (partition by project_id, source_path order by target_path) as n from e), "
    "g as (select project_id, source_path, string_agg(target_path, ', ' order by target_path) as targets from r where n <= 6 group by all) "
    "select project_id, source_path, targets from g qualify row_number() over (partition by project_id order by source_path) <= 50"
)
def dependency_graph(spark, folder):
    """The first fifty sources of each project with their first six targets."""
    e = valid_imports(spark, folder).where("target_path is not null").select("project_id", "source_path", "target_path").distinct()
    n = F.row_number().over(W.partitionBy("project_id", "source_path").orderBy("target_path"))
    g = e.withColumn("n", n).where("n <= 6").groupBy("project_id", "source_path").agg(F.array_join(F.array_sort(F.collect_list("target_path")), ", ").alias("targets"))
    return g.withColumn("r", F.row_number().over(W.partitionBy("project_id").orderBy("source_path"))).where("r <= 50").drop("r")


@query(
    f"with {IMPORTS}, m as (select distinct project_id, case when contains(source_path, '/') then split_part(source_path, '/', 1) else '.' end as module, "
    "case when contains(target_path, '/') then split_part(target_path, '/', 1) else '.' end as imports from imports_v where target_path is not null) select * from m where module <> imports"
)
def module_imports(spark, folder):
    return A.module_edges(valid_imports(spark, folder))


@query(
    f"with {FILES}, c as (select project_id, cast(count(*) filter ({IS_TEST}) as bigint) as test_files, cast(count(*) filter (not {IS_TEST}) as bigint) as source_files from files_v group by project_id) "
    "select *, case when source_files = 0 then 'None detected' when test_files * 100.0 / source_files >= 80 then 'Strong' when test_files * 100.0 / source_files >= 50 then 'Good' "
    "when test_files * 100.0 / source_files >= 25 then 'Moderate' when test_files > 0 then 'Low' else 'None detected' end as label from c"
)
def ratio_label(spark, folder):
    return A.test_counts(valid_files(spark, folder))


@query(
    X.sql(
        f"with {CHUNKS}, f as (select project_id, lower(regexp_extract(rel_path, '\\.[^./]+$')) as ext, lower(coalesce(content, '')) as t from chunks_v where chunk_index < 3 and {IS_TEST}), "
    f"w(ext, framework) as (values {', '.join(f'({listed([e])}, {listed([n])})' for e, ns in fixed.TEST_FRAMEWORKS.items() for n in ns)}) "
    "select distinct project_id, framework from f join w using (ext) where contains(t, framework)"
    )
)
def test_frameworks(spark, folder):
    first = X.with_chunks(valid_chunks(spark, folder)).where("chunk_index < 3").select("project_id", "rel_path", F.col("content").alias("text"))
    return C.test_frameworks(first)


def _architecture_sql() -> str:
    rows = []
    for name, ds, ms in fixed.ARCHITECTURES:
        n = f"len(list_intersect(coalesce(dirs, []), [{listed(ds)}]))"
        s = f"case when {n} >= 2 or ({'true' if len(ds) <= 2 else 'false'} and {n} >= 1) then {n} else 0 end"
        if ms:
            s += f" + 2 * len(list_intersect(coalesce(marks, []), [{listed(ms)}]))"
        rows.append(f"{{'pattern': '{name}', 'score': cast({s} as int)}}")
    return "[" + ", ".join(rows) + "]"


@query(
    X.sql(
        f"with {FILES}, d as (select project_id, list(distinct x) as dirs from (select project_id, unnest(list_transform(string_split(rel_path, '/')[:-2], lambda s: lower(s))) as x from files_v) group by project_id), "
    "m as (select project_id, list(distinct rel_path) as marks from files_v group by project_id), "
    f"e as (select project_id, unnest({_architecture_sql()}) as s from d full join m using (project_id)) "
    "select project_id, s.pattern as pattern, s.score as score, case when s.score >= 3 then 'high' when s.score >= 2 then 'medium' else 'low' end as confidence from e where s.score > 0"
    )
)
def arch_score(spark, folder):
    return A.architectures(X.with_files(valid_files(spark, folder)))


@query(
    X.sql(
        f"with {TEXTS}, n as (select project_id, rel_path, v.priority, v.description from texts join (values "
    + ", ".join(f"('{n}', {k}, '{d}')" for k, (n, d) in enumerate(fixed.ENTRY_POINTS))
    + f") v(name, priority, description) on v.name = {NAME}) "
    "select project_id, rel_path, cast(priority as int) as priority, description from n union all "
    f"select project_id, rel_path, {len(fixed.ENTRY_POINTS)}, '{fixed.GUARDED_SCRIPT}' from texts t anti join n using (project_id, rel_path) where ends_with(rel_path, '.py') and contains(text, '__name__') and contains(text, '__main__')"
    )
)
def entry_points(spark, folder):
    return C.entry_points(X.with_texts(texts(spark, folder)))


@query(
    X.sql(
        f"with {FILES} select distinct project_id, category, v.name as name from files_v join (values "
    + ", ".join(f"('{m.rstrip('/')}', '{c}', '{n}')" for m, c, n in fixed.INFRASTRUCTURE)
    + ") v(m, category, name) on rel_path = m or starts_with(rel_path, m || '/')"
        " union all select project_id, 'ci_cd_detail', cast(count(distinct rel_path) as varchar) || ' workflow(s)' from files_v where regexp_matches(rel_path, '^\\.github/workflows/[^/]*\\.ya?ml$') group by project_id"
    )
)
def infrastructure(spark, folder):
    files = X.with_files(valid_files(spark, folder))
    return A.infrastructure(files).unionByName(A.workflows(files))


@query(
    X.sql(
        f"with {TEXTS} select distinct project_id, v.framework from texts join (values "
    + ", ".join(f"('{m}', '{w}', '{f}')" for m, ws in fixed.FRAMEWORKS.items() for w, f in ws.items())
    + f") v(m, w, framework) on {NAME} = m and contains(lower(text), w)"
    )
)
def frameworks(spark, folder):
    return N.framework_hints(X.with_texts(texts(spark, folder)))


@query(
    X.sql(
        f"""with {TEXTS}, m as (select project_id, {NAME} as name, text from texts),
d as (select project_id, 'npm' as manager, unnest(json_keys(json_extract(text, '$.dependencies'))) as name, false as development from m where name = 'package.json' and json_valid(text)
  union all select project_id, 'npm', unnest(json_keys(json_extract(text, '$.devDependencies'))), true from m where name = 'package.json' and json_valid(text)
  union all select project_id, 'go', unnest(regexp_extract_all(text, '(?m)^\\s+([\\w./\\-]+)\\s+v', 1)), false from m where name = 'go.mod'
  union all select project_id, 'bundler', unnest(regexp_extract_all(text, 'gem\\s+[''"]([^''"]+)[''"]', 1)), false from m where name = 'Gemfile'
  union all select project_id, 'cargo', unnest(list_filter(regexp_extract_all(text, '(?m)^(\\w[\\w-]*)\\s*=', 1), lambda x: x not in ('name', 'version', 'edition', 'authors', 'description', 'license', 'repository'))), false from m where name = 'Cargo.toml'
  union all select project_id, 'pip', unnest(list_transform(list_filter(list_transform(string_split(trim(text, ' ' || chr(10)), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and x[1] <> '#' and x[1] <> '-'), lambda x: trim(regexp_extract(x, '^[^>=<!\\[]*'), ' '))), false from m where name = 'requirements.txt'),
e as (select distinct project_id from d where manager = 'pip' and name <> ''),
toml as (select project_id, 'pip' as manager, unnest(list_transform(regexp_extract_all(regexp_extract(text, '(?s)dependencies\\s*=\\s*\\[(.*?)\\]', 1), '"([^"]+)"', 1), lambda x: trim(regexp_extract(x, '^[^>=<!\\[]*'), ' '))) as name, false as development
  from m anti join e using (project_id) where name = 'pyproject.toml')
select * from d where name <> '' union all select * from toml where name <> ''"""
    )
)
def external_dependencies(spark, folder):
    return N.dependencies(X.with_texts(texts(spark, folder)))


@query(
    f"""with {MEASURES}, {IMPORTS},
fi as (select project_id, target_path as rel_path, count(*) as edges from imports_v where target_path is not null group by all),
s as (select project_id, rel_path, case when contains(rel_path, '/') then split_part(rel_path, '/', 1) else '.' end as module,
  symbols * 2.0::double + case when {NAME} in ({listed(fixed.REPRESENTATIVE_NAMES)}) then 20.0 else 0.0 end + coalesce(edges, 0) * 3.0::double + case when starts_with(lower({NAME}), 'readme') then 15.0 else 0.0 end
  + least(size_bytes / 1024.0::double, 10.0::double) as score from measures left join fi using (project_id, rel_path))
select project_id, module, row_number() over (partition by project_id, module order by score desc, rel_path) as rank, rel_path, round(score, 6) as score from s qualify rank <= 3"""
)
def representative_files(spark, folder):
    return A.representative_files(measures(spark, folder), valid_imports(spark, folder)).withColumn("score", F.round("score", 6))


def _size_sql() -> str:
    cases = []
    for k, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        one = 1024**k
        t = f"(size_bytes * 10 // {one} + case when (size_bytes * 10 % {one}) * 2 > {one} or ((size_bytes * 10 % {one}) * 2 = {one} and (size_bytes * 10 // {one}) % 2 = 1) then 1 else 0 end)"
        cases.append(f"when size_bytes >= {one} then cast({t} // 10 as varchar) || '.' || cast({t} % 10 as varchar) || ' {unit}'")
    return "case " + " ".join(cases) + " else cast(size_bytes as varchar) || ' B' end"


@query(f"with {MEASURES} select project_id, rel_path, size_bytes, {_size_sql()} as size_human from measures")
def human_size(spark, folder):
    """P20."""
    return A.size_label(measures(spark, folder)).select("project_id", "rel_path", "size_bytes", "size_human")


@query(f"with {CHUNKS} select chunk_id, '=== ' || rel_path || ' [lines ' || cast(start_line as varchar) || '-' || cast(end_line as varchar) || ']' || case when coalesce(symbol_name, '') <> '' then ' (' || symbol_name || ')' else '' end || ' ===' as header, rel_path || ' ' || coalesce(symbol_name, '') || chr(10) || left(content, 500) as embedding_text from chunks_v")
def chunk_headers(spark, folder):
    """P23, P38."""
    rows = valid_chunks(spark, folder)
    return rows.select(
        "chunk_id",
        T.chunk_header(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_name")).alias("header"),
        T.embedding_text(F.col("rel_path"), F.col("symbol_name"), F.col("content")).alias("embedding_text"),
    )


@query(f"with {FILES} select project_id, folder, rel_path from files_v join (values ('src'), ('tests/'), ('LIB')) v(folder) on starts_with(lower(rel_path), lower(folder))")
def prefix_join(spark, folder):
    wanted = spark.createDataFrame([("src",), ("tests/",), ("LIB",)], "folder string")
    return R.prefix_matches(wanted, valid_files(spark, folder)).select("project_id", "folder", "rel_path")


@query(f"with {FILES} select project_id, rel_path from files_v f semi join chunk_vectors v using (project_id, rel_path)")
def semi_filter(spark, folder):
    """Files that have a vector."""
    return valid_files(spark, folder).join(table(spark, folder, "chunk_vectors"), ["project_id", "rel_path"], "left_semi").select("project_id", "rel_path")


@query(f"with {FILES} select project_id, rel_path, last_modified from files_v where last_modified > 1735689600")
def changed_since(spark, folder):
    return M.changed_since(valid_files(spark, folder), F.lit(1735689600.0)).select("project_id", "rel_path", "last_modified")


@query("select distinct project_id, rel_path from chunks c anti join files f using (project_id, rel_path)")
def deleted_files(spark, folder):
    """Indexed files that the listing doesn't have."""
    return M.deleted(table(spark, folder, "chunks"), table(spark, folder, "files"), ["project_id", "rel_path"])


@query(
    "with o as (select project_id, rel_path, size_bytes, last_modified from files qualify row_number() over (partition by project_id, rel_path order by scanned_at nulls last, size_bytes nulls last, last_modified nulls last) = 1), "
    f"{FILES} select project_id, rel_path, 'changed' as change from o join files_v f using (project_id, rel_path) where o.size_bytes is distinct from f.size_bytes or o.last_modified is distinct from f.last_modified"
)
def snapshot_diff(spark, folder):
    """The first against the latest scan of every file."""
    key = ["project_id", "rel_path"]
    old = M.keep_first(table(spark, folder, "files"), key, "scanned_at", "size_bytes", "last_modified")
    return M.snapshot_diff(old, valid_files(spark, folder), key, ["size_bytes", "last_modified"])


@query(f"with {SYMBOLS}, g as (select distinct project_id, rel_path from chunks where content is null) select s.* from symbols_v s anti join g using (project_id, rel_path)")
def purged_symbols(spark, folder):
    """Symbols without those of files that lost their content."""
    gone = table(spark, folder, "chunks").where("content is null")
    return M.purge(valid_symbols(spark, folder), gone, ["project_id", "rel_path"]).select("project_id", "rel_path", "name", "line", "type")


@query(
    f"with {FILES}, {SYMBOLS}, t as (select unnest(['queue', 'worker', 'ledger']) as term), p as (select distinct project_id, rel_path from files_v join t on contains(lower(rel_path), term) union "
    "select distinct f.project_id, f.rel_path from files_v f join symbols_v s using (project_id, rel_path) join t on contains(lower(s.name), term)) "
    "select project_id, rel_path from p qualify row_number() over (partition by project_id order by rel_path) <= 6"
)
def substring_match(spark, folder):
    """The first six files of each project with a term in path or symbol."""
    hit = lambda c: T.any_of(F.lower(c), ("queue", "worker", "ledger"))
    files = valid_files(spark, folder).select("project_id", "rel_path")
    by_symbol = valid_symbols(spark, folder).where(hit("name")).select("project_id", "rel_path").distinct()
    both = files.where(hit("rel_path")).unionByName(files.join(by_symbol, ["project_id", "rel_path"], "left_semi")).distinct()
    rank = F.row_number().over(W.partitionBy("project_id").orderBy("rel_path"))
    return both.withColumn("r", rank).where("r <= 6").drop("r")


@query(
    f"""with {MEASURES}, n as (select project_id, rel_path, list(distinct name order by name) as names from symbols_v group by all),
l as (select project_id, rel_path, coalesce(names, []) as names, row_number() over (partition by project_id order by len(coalesce(names, [])) desc, rel_path) as rank from files_v left join n using (project_id, rel_path) qualify rank <= 150)
select project_id, rank, '  ' || rel_path || case when len(names) > 0 then ': [' || array_to_string(names[1:12], ', ') || case when len(names) > 12 then ' (+' || cast(len(names) - 12 as varchar) || ' more)' else '' end || ']' else '' end as line from l"""
)
def project_map(spark, folder):
    """One line for each of the files with most symbols."""
    key = ["project_id", "rel_path"]
    names = valid_symbols(spark, folder).groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = valid_files(spark, folder).select(*key).join(names, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc(F.size("names")), "rel_path"))
    more = F.when(F.size("names") > fixed.MAP_SYMBOLS, F.concat(F.lit(" (+"), (F.size("names") - fixed.MAP_SYMBOLS).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    shown = F.concat(F.lit(": ["), F.array_join(F.slice("names", 1, fixed.MAP_SYMBOLS), ", "), more, F.lit("]"))
    line = F.concat(F.lit("  "), "rel_path", F.when(F.size("names") > 0, shown).otherwise(F.lit("")))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= fixed.MAP_FILES).select("project_id", "rank", line.alias("line"))


@query(
    f"with {FILES}, {SYMBOLS}, e as (select project_id, ext, count(*) as files from files_v group by project_id, ext), s as (select project_id, count(*) as symbols from symbols_v group by project_id) "
    "select project_id, ext, files, coalesce(symbols, 0) as symbols from e left join s using (project_id) qualify row_number() over (partition by project_id order by files desc, ext) <= 8"
)
def synthesis_counts(spark, folder):
    """The eight most frequent suffixes and the number of symbols, as a project's summary is asked for."""
    e = valid_files(spark, folder).groupBy("project_id", "ext").agg(F.count("*").alias("files"))
    n = valid_symbols(spark, folder).groupBy("project_id").agg(F.count("*").alias("symbols"))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("files"), "ext"))
    return e.withColumn("r", rank).where("r <= 8").drop("r").join(n, "project_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


@query(
    f"with {MEASURES}, c as (select project_id, rel_path, row_number() over (partition by project_id order by symbols desc, rel_path) as o from measures qualify o <= 5), "
    "b as (select project_id, rel_path, 0 as p, cast(o as varchar) as k from c union all select project_id, rel_path, 1, rel_path from measures m anti join c using (project_id, rel_path)) "
    "select project_id, rel_path, row_number() over (partition by project_id order by p, k, rel_path) as position from b"
)
def ranking_completed(spark, folder):
    """The files a ranking chose, then all others by path."""
    m = measures(spark, folder)
    chosen = A.top_files(m, "symbols").select("project_id", "rel_path", F.lit(0).alias("p"), F.col("rank").cast("string").alias("k"))
    rest = m.join(chosen, ["project_id", "rel_path"], "left_anti").select("project_id", "rel_path", F.lit(1).alias("p"), F.col("rel_path").alias("k"))
    position = F.row_number().over(W.partitionBy("project_id").orderBy("p", "k", "rel_path"))
    return chosen.unionByName(rest).select("project_id", "rel_path", position.cast("bigint").alias("position"))


@query(
    f"with {TEXTS}, n as (select *, row_number() over (partition by project_id order by rel_path) as o, least(length(text), 8000) as size from texts where coalesce(text, '') <> ''), "
    "u as (select *, coalesce(sum(size) over (partition by project_id order by o rows between unbounded preceding and 1 preceding), 0) as before from n) "
    "select project_id, rel_path, cast(least(size, 24000 - before) as bigint) as chars from u where before < 24000"
)
def files_in_budget(spark, folder):
    """W06 on raw texts: whole files in order of path, 8,000 characters of each at most, until 24,000 are used."""
    rows = texts(spark, folder).where(F.coalesce("text", F.lit("")) != "").select("project_id", "rel_path", F.least(F.length("text"), F.lit(fixed.FILE_CHARS)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("project_id").orderBy("rel_path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < fixed.CONTEXT_CHARS).select("project_id", "rel_path", F.least(F.col("size"), fixed.CONTEXT_CHARS - F.col("before")).cast("bigint").alias("chars"))


@query(
    f"with {IMPORTS}, d as (select distinct project_id, target_path from imports_v where target_path is not null), {FILES} "
    "select d.project_id, d.target_path, f.rel_path is not null as known from d left join files_v f on d.project_id = f.project_id and d.target_path = f.rel_path"
)
def targets_validated(spark, folder):
    """Which named files a project really has."""
    d = valid_imports(spark, folder).where("target_path is not null").select("project_id", "target_path").distinct()
    have = valid_files(spark, folder).select("project_id", F.col("rel_path").alias("target_path"), F.lit(True).alias("known"))
    return d.join(have, ["project_id", "target_path"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


# ---------------------------------------------------------------- catalogue of projects


@query("select project_id, slug, project_root, schema_version, file_count, indexed_at from projects where schema_version = 7")
def project_catalogue(spark, folder):
    """S22, with the version gate of S11: other versions are indexed anew, not read."""
    rows = table(spark, folder, "projects").where(F.col("schema_version") == fixed.SCHEMA_VERSION)
    return rows.select("project_id", "slug", "project_root", "schema_version", "file_count", "indexed_at")


@query("select project_id from projects order by indexed_at desc nulls last, project_id limit 1")
def latest_project(spark, folder):
    """S21."""
    return table(spark, folder, "projects").orderBy(F.desc_nulls_last("indexed_at"), "project_id").limit(1).select("project_id")


@query("select project_id, case when project_root = '/srv/checkouts/atlas-core' then 0 when slug = '/srv/checkouts/atlas-core' then 1 else 2 end as way from projects where '/srv/checkouts/atlas-core' in (project_root, slug, project_id) order by way, project_id limit 1")
def resolve_project(spark, folder):
    """By root, slug or id, in that order; nothing for an unknown name."""
    from codelode.operators.catalog import resolve

    return resolve(table(spark, folder, "projects"), "/srv/checkouts/atlas-core")


@query("select project_id, lower(replace(regexp_extract(project_root, '[^/]*$'), ' ', '-')) as slug, lower(replace(regexp_extract(project_root, '[^/]*$'), ' ', '-')) || '_' || substr(sha256(project_root), 1, 12) as made_id from projects")
def slug_and_id(spark, folder):
    root = F.col("project_root")
    return table(spark, folder, "projects").select("project_id", T.slug(root).alias("slug"), T.project_id(root).alias("made_id"))


@query(
    "select project_id, coalesce(nullif(regexp_extract(trim(repo_url, ' '), '^(?:https?://)?(?:www\\.)?code\\.example/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+?)(?:\\.git)?/?$', 1), ''), "
    "nullif(regexp_extract(trim(repo_url, ' '), '^([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)$', 1), '')) as repository from projects"
)
def repositories(spark, folder):
    """P18."""
    return table(spark, folder, "projects").select("project_id", T.repository(F.col("repo_url"), r"code\.example").alias("repository"))


@query(
    f"with {FILES}, c as (select project_id, count(*) as files from files_v group by project_id) select project_id, file_count, coalesce(files, 0) as files, file_count is distinct from coalesce(files, 0) as stale from projects left join c using (project_id)"
)
def stale_projects(spark, folder):
    """Projects whose count of files isn't current."""
    c = valid_files(spark, folder).groupBy("project_id").agg(F.count("*").alias("files"))
    rows = table(spark, folder, "projects").join(c, "project_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return rows.select("project_id", "file_count", "files", (~F.col("file_count").cast("bigint").eqNullSafe(F.col("files"))).alias("stale"))


REPORT = f"""{MEASURES}{TEXTS[len(CHUNKS):]}, {IMPORTS},
tot as (select project_id, count(*) as total_files, cast(sum(lines) as bigint) as total_lines, cast(sum(size_bytes) as bigint) as total_size_bytes, cast(sum(symbols) as bigint) as total_symbols, max(symbols) as most_symbols from measures group by project_id),
tst as (select project_id, count(*) filter ({IS_TEST}) as test_files, count(*) filter (not {IS_TEST}) as source_files from files_v group by project_id),
lab as (select *, case when source_files = 0 then 'None detected' when test_files * 100.0 / source_files >= 80 then 'Strong' when test_files * 100.0 / source_files >= 50 then 'Good' when test_files * 100.0 / source_files >= 25 then 'Moderate' when test_files > 0 then 'Low' else 'None detected' end as test_label from tst),
adirs as (select project_id, list(distinct x) as dirs from (select project_id, unnest(list_transform(string_split(rel_path, '/')[:-2], lambda s: lower(s))) as x from files_v) group by project_id),
amarks as (select project_id, list(distinct rel_path) as marks from files_v group by project_id),
ascore as (select project_id, unnest({_architecture_sql()}) as s from adirs full join amarks using (project_id)),
arch as (select project_id, first(s.pattern order by s.score desc, s.pattern desc) as pattern from ascore where s.score > 0 group by project_id),
fw as (select project_id, string_agg(framework, ', ' order by framework) as frameworks from (select distinct project_id, v.framework from texts join (values {", ".join(f"('{m}', '{w}', '{f}')" for m, ws in fixed.FRAMEWORKS.items() for w, f in ws.items())}) v(m, w, framework) on {NAME} = m and contains(lower(text), w)) group by project_id),
inf as (select distinct project_id, category, v.name as name from files_v join (values {", ".join(f"('{m.rstrip('/')}', '{c}', '{n}')" for m, c, n in fixed.INFRASTRUCTURE)}) v(m, category, name) on rel_path = m or starts_with(rel_path, m || '/')),
ci as (select project_id, string_agg(name, ', ' order by name) as ci_cd from inf where category = 'ci_cd' group by project_id),
co as (select project_id, string_agg(name, ', ' order by name) as containers from inf where category = 'containerization' group by project_id),
ne as (select project_id, rel_path, v.priority as p from texts join (values {", ".join(f"('{n}', {k})" for k, (n, _) in enumerate(fixed.ENTRY_POINTS))}) v(name, priority) on v.name = {NAME}),
ae as (select * from ne union all select project_id, rel_path, {len(fixed.ENTRY_POINTS)} from texts t anti join ne using (project_id, rel_path) where ends_with(rel_path, '.py') and contains(text, '__name__') and contains(text, '__main__')),
re as (select *, row_number() over (partition by project_id order by p, rel_path) as r from ae),
en as (select project_id, string_agg(rel_path, ', ' order by r) as entries, string_agg(rel_path, ', ' order by r) filter (r <= 3) as first_entries from re where r <= {fixed.REPORT_ENTRIES} group by project_id),
fi as (select project_id, target_path, row_number() over (partition by project_id order by count(*) desc, target_path) as r from imports_v where target_path is not null group by project_id, target_path qualify r <= 10),
tc as (select project_id, string_agg(target_path, ', ' order by r) as top_connected from fi group by project_id),
le as (select project_id, ext, row_number() over (partition by project_id order by count(*) desc, ext) as r from files_v where ext <> '' group by project_id, ext qualify r <= 20),
la as (select project_id, string_agg(ext, ', ' order by r) as languages from le group by project_id),
report as (select * from tot left join lab using (project_id) left join arch using (project_id) left join fw using (project_id) left join ci using (project_id) left join co using (project_id) left join en using (project_id) left join tc using (project_id) left join la using (project_id))"""


@query(
    X.sql(
        f"""with {REPORT}
select project_id, unnest(list_filter([
  case when total_files < 10 then 'Small project with ' || total_files || ' files' when total_files < 50 then 'Medium-sized project: ' || total_files || ' files' when total_files < 200 then 'Substantial project: ' || total_files || ' files' else 'Large codebase: ' || total_files || ' files' end,
  'Architecture: ' || pattern, 'Tech stack: ' || frameworks,
  case when test_files > 0 then 'Test coverage: ' || test_label else 'No test files detected' end,
  'CI/CD: ' || ci_cd, 'Containerized with ' || containers, 'Entry points: ' || first_entries,
  case when total_lines // total_files > 300 then 'Average file length is ' || (total_lines // total_files) || ' lines' when total_lines > 0 then 'Clean file sizes averaging ' || (total_lines // total_files) || ' lines per file' end,
  case when most_symbols > 20 then 'Most complex file has ' || most_symbols || ' symbols' end], lambda x: x is not null)) as insight from report"""
    )
)
def insights(spark, folder):
    """P36, every sentence."""
    return A.insights(_report(spark, folder))


def _report(spark, folder):
    from .report import project_rows

    files, chunks = X.with_files(valid_files(spark, folder)), X.with_chunks(valid_chunks(spark, folder))
    return project_rows(files, chunks, valid_symbols(spark, folder), valid_imports(spark, folder), X.with_texts(texts(spark, folder)))


LISTS = ("frameworks", "ci_cd", "containers", "entries", "top_connected", "languages")


@query(
    X.sql(
        f"with {REPORT} select project_id, total_files, total_lines, total_size_bytes, total_symbols, most_symbols, test_files, source_files, test_label, pattern, "
        + ", ".join(f"coalesce({c}, '') as {c}" for c in LISTS) + " from report"
    )
)
def project_report(spark, folder):
    """The report of every project in one row."""
    return _report(spark, folder).select(
        "project_id", "total_files", "total_lines", "total_size_bytes", "total_symbols", "most_symbols", "test_files", "source_files", "test_label", "pattern",
        *(F.array_join(c, ", ").alias(c) for c in LISTS),
    )


@query(
    f"with {IMPORTS}, {SYMBOLS}, t as (select project_id, target_path, count(*) as imported_by, row_number() over (partition by project_id order by count(*) desc, target_path) as rank from imports_v where target_path is not null group by project_id, target_path qualify rank <= 10), "
    "n as (select distinct s.project_id, s.rel_path as target_path, s.name, s.line from symbols_v s join t on s.project_id = t.project_id and s.rel_path = t.target_path), "
    "r as (select *, row_number() over (partition by project_id, target_path order by line nulls first, name) as o from n qualify o <= 8), "
    "g as (select project_id, target_path, string_agg(name, ', ' order by o) as symbols from r group by all) "
    "select project_id, target_path, imported_by, rank, coalesce(symbols, '') as symbols from t left join g using (project_id, target_path)"
)
def connected_symbols(spark, folder):
    """The most imported files with their first eight symbols."""
    rows = A.connected_symbols(A.fan_in(valid_imports(spark, folder)), valid_symbols(spark, folder))
    return rows.withColumn("symbols", F.array_join("symbols", ", "))
