"""Facade: everything a user does with projects, questions, reports and sessions."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions import text as T
from codelode.operators import analytics as A
from codelode.operators import catalog, manifests
from codelode.operators import code as C
from codelode.operators import keywords as K
from codelode.operators import maintenance as M
from codelode.operators import retrieval as R
from codelode.plans import index as I
from codelode.plugins import ANSWER_SCHEMA, MODULE_SCHEMA, PROJECT_SCHEMA, Answer, Embedder, LanguageModel, Navigation, Offline, StreamEvent, ask_where, embedded, rerank, streamed, structured, with_retry
from codelode.sources import repo
from codelode.sources.store import Store
from codelode.sources.tree import list_tree, read_texts
from codelode.streaming.watch import Watchers


ANSWER = "Answer the question from the context; cite the places in the code by file and line."


class Engine:
    def __init__(self, spark: SparkSession, store: str, model: LanguageModel | None = None, embedder: Embedder | None = None):
        self.spark, self.store = spark, Store(spark, store)
        self.model, self.embedder = model or Offline(), embedder
        self.watchers = Watchers(spark, f"{store.rstrip('/')}/watch")

    # ------------------------------------------------------------ projects

    def _id(self, root: str) -> str:
        one = self.spark.createDataFrame([(os.path.realpath(root),)], "root string")
        return one.select(T.project_id(F.col("root"))).first()[0]

    def resolve(self, name: str = "") -> str | None:
        """Empty: the latest project; else by root, slug or id; None for an unknown name."""
        projects = self.store.projects()
        if not name:
            found = catalog.latest(projects).first()
        else:
            found = catalog.resolve(projects, os.path.realpath(name) if os.path.isdir(name) else name).first()
        return found and found["project_id"]

    def _need(self, name: str) -> str:
        found = self.resolve(name)
        if found is None:
            raise LookupError(f"no indexed project: {name or '(none)'}")
        return found

    def _table(self, table: str, project: str) -> DataFrame:
        return self.store.get(table, project)

    def index_project(self, root: str, repo_url: str | None = None, background: bool = False) -> dict:
        """Scan, extract and publish in one step; the time stamp is that of the scan's start.

        Enrichment is a publication of its own that follows, in a thread of its own with background=True.
        """
        began, root = time.time(), os.path.realpath(root)
        project = self._id(root)
        listing = list_tree(self.spark, root).persist()
        texts = read_texts(listing).where("error is null").select("rel_path", F.col("content").alias("text")).persist()
        try:
            self.store.publish(project, I.build(listing, texts))
        finally:
            listing.unpersist()
            texts.unpersist()
        self._register(project, root, began, repo_url)
        if self.embedder:
            self.embed(project)
        if background:
            self._state(project, "enriching")
            self.enriching = threading.Thread(target=self._enrich, args=(project,), daemon=True)
            self.enriching.start()
        else:
            self._enrich(project)
        count = lambda t: self._table(t, project).count()
        return {"project_id": project, "files": count("files"), "chunks": count("chunks"), "symbols": count("symbols"), "keywords": self._table("keyword_files", project).select("keyword").distinct().count()}

    def _register(self, project: str, root: str, at: float, repo_url: str | None) -> None:
        n = self._table("files", project).count()
        one = self.spark.createDataFrame([(root, repo_url, fixed.SCHEMA_VERSION, n, at)], "project_root string, repo_url string, schema_version int, file_count int, indexed_at double")
        self.store.register(project, one.withColumn("slug", T.slug(F.col("project_root"))))

    def _state(self, project: str, state: str) -> None:
        self.store.write("status", project, self.spark.createDataFrame([(state, time.time())], "state string, at double"))

    def embed(self, project: str) -> None:
        """Vectors are a table of their own; neither enrichment nor an update of other files drops them."""
        rows = self._table("chunks", project).withColumn("t", T.embedding_text(F.col("rel_path"), F.col("symbol_name"), F.col("content")))
        self.store.write("embeddings", project, embedded(rows, self.embedder, ["rel_path", "chunk_index"], "t"))

    def _enrich(self, project: str) -> None:
        """Summaries of modules, then of the project from these; written in one publication of their own tables.

        A module whose summary fails is left out; without any the project has none.
        """
        self._state(project, "enriching")
        try:
            edges = self._edges(project)
            chosen = A.representative_files(self._measures(project), edges).join(self._table("texts", project), "rel_path").orderBy("module", "rank")
            chosen = chosen.select("module", "rel_path", F.substring("text", 1, fixed.SUMMARY_CHARS).alias("text"))
            leads: dict[str, list[str]] = {}
            for r in A.module_edges(edges).orderBy("module", "imports").collect():
                leads.setdefault(r["module"], []).append(r["imports"])
            by: dict[str, list] = {}
            for r in chosen.toLocalIterator():  # three files of each module, the head of each
                by.setdefault(r["module"], []).append(r)
            said = []
            for module, files in sorted(by.items()):
                prompt = "\n\n".join([f"Module {module} imports: {', '.join(leads.get(module, [])) or 'nothing'}", *(f"=== {r['rel_path']} ===\n{r['text'] or ''}" for r in files)])
                try:
                    got = structured(self.model, "Summarise this module.", prompt, MODULE_SCHEMA, 300)
                except Exception:  # noqa: BLE001
                    continue
                said.append((module, got["purpose"], got["key_patterns"], got["domain_concepts"], got["key_abstractions"]))
            rows = self.spark.createDataFrame(said, "module_path string, summary string, key_patterns array<string>, domain_concepts array<string>, key_abstractions array<string>")
            tables = {"module_summaries": rows}
            if said:
                parts = [f"{m}/: {t}\n  Patterns: {', '.join(p)}\n  Domain: {', '.join(d)}\n  Key: {', '.join(k[:5])}" for m, t, p, d, k in said]
                files, symbols = self._table("files", project), self._table("symbols", project)
                suffixes = files.groupBy(F.lower(T.suffix(F.col("rel_path"))).alias("ext")).count().orderBy(F.desc("count"), "ext").limit(8).collect()
                readme = self._table("texts", project).where(F.lower("rel_path").startswith("readme")).orderBy("rel_path").select(F.substring("text", 1, 1500).alias("t")).first()
                parts += [f"README:\n{readme['t']}"] if readme else []
                parts += [f"Languages: {', '.join(f'{r[0]}: {r[1]}' for r in suffixes)}", f"Total files: {files.count()}, Total symbols: {symbols.count()}"]
                parts += ["Module dependencies: " + "; ".join(f"{m} -> {', '.join(t)}" for m, t in leads.items())] if leads else []
                got = structured(self.model, "Summarise this project.", "\n".join(parts), PROJECT_SCHEMA, 500)
                pairs = [(k, json.dumps(v) if isinstance(v, list) else v) for k, v in got.items()]
                tables["semantic_summary"] = self.spark.createDataFrame(pairs, "key string, value string")
            self.store.publish(project, tables)
            self._state(project, "complete")
        except Exception:
            self._state(project, "failed")
            raise

    def enrichment_status(self, name: str = "") -> str:
        project = self._need(name)
        row = self._table("status", project).first()
        return row["state"] if row else "complete" if self._table("semantic_summary", project).count() else "unknown"

    def update_index(self, root: str) -> dict:
        """Only files that changed are read again; imports are resolved anew for all, as their targets may have changed."""
        began, root = time.time(), os.path.realpath(root)
        project = self._need(root)
        listing = list_tree(self.spark, root).persist()
        old = self._table("listing", project)  # also files without a text that is indexed
        gone = M.deleted(old, listing, ["rel_path"]).persist()
        new = I.changed(listing, old).persist()
        held = [listing, gone, new]
        try:
            updated, deleted = [r[0] for r in new.select("rel_path").collect()], [r[0] for r in gone.collect()]  # names of one tree's changes
            if not updated and not deleted:
                return {"updated": [], "deleted": []}
            fresh = read_texts(new).where("error is null").select("rel_path", F.col("content").alias("text"))
            touched = gone.select("rel_path").unionByName(new.select("rel_path"))
            kept = self._table("texts", project).join(touched, "rel_path", "left_anti")
            texts = kept.unionByName(fresh).persist()
            held.append(texts)
            tables = I.build(listing, texts)
            vectors = self.store.read("embeddings", project)
            if vectors is not None:
                tables["embeddings"] = M.purge(vectors, touched, ["rel_path"])
            self.store.publish(project, tables)  # one step; the folders read here stay for the store's time of grace
        finally:
            for df in held:
                df.unpersist()
        self._register(project, root, began, None)
        return {"updated": sorted(updated), "deleted": sorted(deleted)}

    def watch(self, root: str, once: bool = False):
        return self.watchers.start(root, lambda batch: self.update_index(root), once)

    def unwatch(self, root: str) -> bool:
        return self.watchers.stop(root)

    def clone_and_index(self, url: str, into: str) -> dict:
        at = repo.fetch(url, into)
        return self.index_project(str(at), url) | {"repository": repo.parse(url)}

    def delete_project(self, name: str) -> bool:
        project = self.resolve(name)
        return bool(project) and self.store.delete(project)

    def list_projects(self) -> DataFrame:
        return self.store.projects().orderBy("project_id")

    # ------------------------------------------------------------ reading

    def list_project_files(self, name: str = "") -> DataFrame:
        return self._table("files", self._need(name)).orderBy("rel_path")

    def get_file_content(self, path: str, name: str = "") -> dict:
        """The text of a file with what the index has of it; for an unknown one an error and the first twenty paths."""
        project = self._need(name)
        mine = lambda t: self._table(t, project).where(F.col("rel_path") == path)
        row, meta = mine("texts").first(), mine("files").first()
        if row is None:
            some = self._table("files", project).orderBy("rel_path").limit(20).collect()
            return {"error": f"not in the index: {path}", "content": "", "available_files": [r["rel_path"] for r in some]}
        text = row["text"] or ""
        return {
            "file_path": path, "project_id": project, "content": text, "line_count": text.count("\n") + 1 if text else 0,
            "symbols": [r[0] for r in mine("symbols").orderBy("line", "name").select("name").collect()], "keywords": [r[0] for r in mine("keyword_files").orderBy("keyword").select("keyword").collect()],
            "extension": meta["extension"] if meta else "", "size_bytes": meta["size_bytes"] if meta else 0, "chunks_count": mine("chunks").count(),
        }

    def search_code(self, text: str, name: str = "") -> dict:
        hits = R.search_lines(self._table("texts", self._need(name)), ["rel_path"], text)
        found = [r.asDict() for r in hits.collect()]
        return {"matches": found, "truncated": len(found) >= fixed.SEARCH_HITS}

    def _vector_hits(self, question: str, project: str) -> DataFrame | None:
        vectors = self.store.read("embeddings", project)
        if vectors is None or self.embedder is None:
            return None
        q = self.spark.createDataFrame([(self.embedder.embed([question])[0].tolist(),)], "q array<float>")
        return R.vector_hits(vectors, q, ["rel_path", "chunk_index"])

    def _scores(self, question: str, project: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
        """(scores, symbol hits, number of files, terms) of a question, from the stored index; no text is read."""
        files, symbols = self._table("files", project), self._table("symbols", project)
        terms = [r["keyword"] for r in K.query_terms(files, question).collect()]  # ten at most
        total = files.agg(F.count("*").alias("n"))
        parts = K.idf_scores(K.stored_postings(self._table("keyword_files", project), terms), ["rel_path"], total)
        scores = R.combined(parts, symbols, question, self._vector_hits(question, project))
        words = self.spark.createDataFrame([(w,) for w in sorted(set(question.lower().split()))], "word string")
        hits = symbols.join(F.broadcast(words), F.lower("name") == F.col("word")).orderBy("name", "rel_path", "line")
        return scores, hits, total, terms

    def find_relevant_files(self, question: str, name: str = "", k: int = fixed.TOP_FILES) -> dict:
        """Hybrid ranking with confidence and symbol places, by way of the stored index."""
        scores, hits, total, terms = self._scores(question, self._need(name))
        scores = scores.persist()
        try:
            one = R.confidence_inputs(scores, self.spark.createDataFrame([(t,) for t in terms], "keyword string"), total, hits)
            row = one.select("*", T.confidence(F.col("hits"), F.col("ranked"), F.col("ratio")).alias("confidence")).first()
            best = K.ranked(scores, "rel_path", k).collect()
        finally:
            scores.unpersist()
        return {
            "files": [r["rel_path"] for r in best], "scores": [r["score"] for r in best], "confidence": row["confidence"],
            "symbol_hits": [r.asDict() for r in hits.select("name", "rel_path", "line", "type").limit(fixed.SEARCH_HITS).collect()],
        }

    def retrieve_context(self, question: str, name: str = "") -> dict:
        """The chunks of the best files within the budget."""
        project = self._need(name)
        found = self.find_relevant_files(question, name)
        if not found["files"]:
            return found | {"context": ""}
        top = self.spark.createDataFrame(list(zip(found["files"], range(len(found["files"])), strict=True)), "rel_path string, file_rank int")
        chunks = self._table("chunks", project).withColumn("one", F.lit(1))
        row = R.packed_context(top, chunks, ["one"]).first()
        return found | {"context": "\n\n".join([row["context"] if row else "", *self._hints(found)]).strip()}

    @staticmethod
    def _hints(found: dict) -> list[str]:
        return [f"[Symbol `{h['name']}` defined in {h['rel_path']} at line {h['line']} ({h['type']})]" for h in found["symbol_hits"]]

    def retrieve_reranked(self, question: str, name: str = "") -> dict:
        """The chunks of the ten best files in the order the model gives them, until the budget is used."""
        project = self._need(name)
        found = self.find_relevant_files(question, name, fixed.RERANK_FILES)
        top = self.spark.createDataFrame(list(zip(found["files"], range(len(found["files"])), strict=True)), "rel_path string, file_rank int")
        rows = self._table("chunks", project).join(F.broadcast(top), "rel_path").where("content is not null").orderBy("file_rank", "chunk_index")
        first = R.running_context(rows.withColumn("one", F.lit(1)), ["one"], ["file_rank", "chunk_index"], F.length("content"), 10 * fixed.CONTEXT_CHARS)
        chunks = [r.asDict() for r in first.orderBy("file_rank", "chunk_index").collect()]  # ten times the budget at most
        order = rerank(self.model, question, chunks)
        listed = self.spark.createDataFrame(
            [(k, c["rel_path"], c["start_line"], c["end_line"], c["symbol_name"], c["content"]) for k, c in enumerate(chunks[i] for i in order)],
            "k int, rel_path string, start_line int, end_line int, symbol_name string, content string",
        )
        part = F.concat(T.chunk_header(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_name")), F.lit("\n"), F.col("content"))
        kept = R.running_context(listed.withColumn("part", part).withColumn("one", F.lit(1)), ["one"], ["k"], F.length("part")).orderBy("k").collect()
        files = list(dict.fromkeys(r["rel_path"] for r in kept))[: fixed.TOP_FILES]
        return found | {"files": files, "context": "\n\n".join([*(r["part"] for r in kept), *self._hints(found)]).strip()}

    def read_files(self, paths: list[str], name: str = "", budget: int = fixed.CONTEXT_CHARS) -> str:
        """Numbered texts of at most FILE_CHARS each, until the budget is used."""
        project, parts, used = self._need(name), [], 0
        wanted = list(dict.fromkeys(paths))
        texts = {r["rel_path"]: r["text"] for r in self._table("texts", project).where(F.col("rel_path").isin(wanted)).collect()}
        for path in wanted:
            if used >= budget:
                break
            text = texts.get(path)
            if not text:
                continue
            most = min(budget - used, fixed.FILE_CHARS)
            text = text if len(text) <= most else text[:most] + "\n... (truncated)"
            body = "\n".join(f"{i:4d} | {line}" for i, line in enumerate(text.split("\n"), 1))
            head = f"=== FILE: {path} [lines 1-{text.count(chr(10)) + 1}] ==="
            parts.append(f"{head}\n{body}")
            used += len(head) + len(body) + 2
        return "\n\n".join(parts)

    # ------------------------------------------------------------ reports

    def _measures(self, project: str) -> DataFrame:
        files = self._table("files", project).select(F.lit(project).alias("project_id"), "rel_path", F.lower(T.suffix(F.col("rel_path"))).alias("ext"), "size_bytes")
        tag = lambda t: self._table(t, project).withColumn("project_id", F.lit(project))
        return A.file_measures(files, tag("chunks"), tag("symbols"))

    def _edges(self, project: str) -> DataFrame:
        return self._table("file_imports", project).withColumn("project_id", F.lit(project))

    def project_report(self, name: str = "") -> dict:
        """Every aggregate of the report; each is small, whatever the project's size."""
        project = self._need(name)
        files = self._table("files", project).withColumn("project_id", F.lit(project)).withColumn("ext", F.lower(T.suffix(F.col("rel_path"))))
        texts = self._table("texts", project).withColumn("project_id", F.lit(project))
        rows = self._measures(project).persist()
        root = self.store.projects().where(F.col("project_id") == project).first()["project_root"]
        listing = (list_tree(self.spark, root, every=True) if os.path.isdir(root) else files).withColumn("project_id", F.lit(project))
        dicts = lambda df: [r.asDict(True) for r in df.collect()]
        drop = lambda df, *order: dicts(df.drop("project_id").orderBy(*order))
        total = A.totals(rows).first()
        first = self._table("chunks", project).where("chunk_index < 3").select(F.lit(project).alias("project_id"), "rel_path", F.col("content").alias("text"))
        mani = listing.where(T.file_name(F.col("rel_path")).isin(*fixed.DEPENDENCY_FILES) & ~F.contains("rel_path", F.lit("/")))
        mani = read_texts(mani).select(F.lit(project).alias("project_id"), "rel_path", F.col("content").alias("text")) if "path" in mani.columns else texts.limit(0)
        readmes = texts.where(F.lower("rel_path").startswith("readme"))
        report = {
            "complexity": total.asDict() | {"largest_files": drop(A.top_files(rows, "size_bytes"), "rank"), "longest_files": drop(A.top_files(rows, "lines"), "rank"), "most_complex_files": drop(A.top_files(rows, "symbols"), "rank")},
            "language_breakdown": drop(A.language_lines(rows), "rank"),
            "architecture": drop(A.architectures(files, listing), F.desc("score"), "pattern"),
            "entry_points": dicts(C.entry_points(texts).drop("project_id").orderBy("priority", "rel_path").limit(fixed.REPORT_ENTRIES)),
            "infrastructure": drop(A.infrastructure(listing).unionByName(A.workflows(listing)), "category", "name"),
            "tests": A.test_counts(files).first().asDict() | {"frameworks": [r["framework"] for r in C.test_frameworks(first).orderBy("framework").collect()]},
            "external_dependencies": drop(manifests.dependencies(mani), "manager", "name"),
            "frameworks": [r["framework"] for r in manifests.framework_hints(mani).orderBy("framework").collect()],
            "top_connected_files": drop(A.connected_symbols(A.fan_in(self._edges(project)), self._table("symbols", project).withColumn("project_id", F.lit(project))), "rank"),
            "description": (manifests.description(readmes).orderBy("rel_path").first() or {"description": ""})["description"],
            "directory_tree": drop(A.directory_counts(files), "top", "sub"),
        }
        one = A.totals(rows).join(rows.groupBy("project_id").agg(F.max("symbols").alias("most_symbols")), "project_id").join(A.test_counts(files).withColumnRenamed("label", "test_label"), "project_id")
        words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        infra = report["infrastructure"]
        one = (
            one.withColumn("pattern", F.lit(report["architecture"][0]["pattern"] if report["architecture"] else None).cast("string"))
            .withColumn("frameworks", words(report["frameworks"]))
            .withColumn("ci_cd", words([x["name"] for x in infra if x["category"] == "ci_cd"]))
            .withColumn("containers", words([x["name"] for x in infra if x["category"] == "containerization"]))
            .withColumn("entries", words([x["rel_path"] for x in report["entry_points"]]))
        )
        report["insights"] = [r["insight"] for r in A.insights(one).collect()]
        rows.unpersist()
        return report

    def project_overview(self, name: str = "") -> dict:
        project = self._need(name)
        said = {r["key"]: r["value"] for r in self._table("semantic_summary", project).collect()}
        modules = [r.asDict() for r in self._table("module_summaries", project).orderBy("module_path").collect()]
        return {"summary": said, "modules": modules, "report": self.project_report(name)}

    def query_categories(self, category: str | None = None, name: str = "") -> dict:
        """Categorised symbols, with the number of symbols and files of each category."""
        rows = self._table("symbol_categories", self._need(name))
        rows = rows.where(F.col("category") == category) if category else rows
        counts = rows.groupBy("category").agg(F.count("*").alias("symbols"), F.countDistinct("rel_path").alias("files")).orderBy("category")
        return {"categories": {r["category"]: {"symbols": r["symbols"], "files": r["files"]} for r in counts.collect()}, "rows": rows}

    def query_imports(self, path: str | None = None, name: str = "") -> dict:
        rows = self._table("file_imports", self._need(name))
        rows = rows.where(F.col("source_path") == path) if path else rows
        counts = rows.agg(F.count("target_path").alias("internal"), F.count_if(F.col("target_path").isNull()).alias("external")).first()
        return {"imports": rows, "internal": counts["internal"], "external": counts["external"]}

    # ------------------------------------------------------------ questions

    def project_map(self, project: str) -> str:
        """The files with most symbols, one line each."""
        names = self._table("symbols", project).groupBy("rel_path").agg(F.array_sort(F.collect_set("name")).alias("n"))
        rows = self._table("files", project).join(names, "rel_path", "left")
        best = rows.orderBy(F.desc(F.coalesce(F.size("n"), F.lit(0))), "rel_path").limit(fixed.MAP_FILES).collect()
        return "\n".join(f"  {r['rel_path']}" + (f": [{', '.join(r['n'][: fixed.MAP_SYMBOLS])}]" if r["n"] else "") for r in best)

    def navigate(self, question: str, name: str = "") -> Navigation:
        """The model's choice of files, those that exist kept (J06); else the rules of the fallback."""
        project = self._need(name)
        chosen = ask_where(self.model, question, self.project_map(project))
        if chosen is not None:
            files = self._table("files", project)
            have = {r[0] for r in files.where(F.col("rel_path").isin(chosen.target_files)).select("rel_path").collect()}
            chosen.target_files = [f for f in chosen.target_files if f in have]
            if chosen.target_files or chosen.target_folders or not chosen.needs_code:
                return chosen
        low = question.lower()
        if any(w in low for w in fixed.OVERVIEW_WORDS) or any(w in low for w in fixed.AGGREGATE_WORDS):
            return Navigation(False, reasoning="summaries and categories are enough")
        terms = [r["keyword"] for r in K.query_terms(self._table("files", project), question, fixed.FALLBACK_KEYWORDS).collect()]
        hit = T.any_of(F.lower("rel_path"), tuple(terms)) if terms else F.lit(False)
        by_name = self._table("symbols", project).where(T.any_of(F.lower("name"), tuple(terms)) if terms else F.lit(False)).select("rel_path")
        paths = self._table("files", project).where(hit).select("rel_path").unionByName(by_name).distinct().orderBy("rel_path").limit(6)
        return Navigation(True, [r[0] for r in paths.collect()], [], "keywords", terms)

    def folder_files(self, folders: list[str], project: str, k: int = 3) -> list[str]:
        """The files with most symbols below each folder."""
        if not folders:
            return []
        wanted = self.spark.createDataFrame([(f.rstrip("/"),) for f in folders], "folder string")
        n = self._table("symbols", project).groupBy("rel_path").agg(F.count("*").alias("n"))
        rows = R.prefix_matches(wanted, self._table("files", project)).join(n, "rel_path", "left")
        rank = F.row_number().over(W.partitionBy("folder").orderBy(F.desc(F.coalesce("n", F.lit(0))), "rel_path"))
        return [r["rel_path"] for r in rows.withColumn("r", rank).where(F.col("r") <= k).orderBy("folder", "r").collect()]

    def summary_context(self, name: str = "") -> str:
        """What the summaries say of the project and its modules."""
        project = self._need(name)
        whole = {r["key"]: r["value"] for r in self._table("semantic_summary", project).collect() if r["value"]}
        parts = ["=== PROJECT ===", *(f"{k}: {whole[k]}" for k in PROJECT_SCHEMA if k in whole)] if whole else []
        modules = self._table("module_summaries", project).where("summary <> ''").orderBy("module_path").limit(fixed.MAP_FILES).collect()
        parts += ["=== MODULES ===", *(f"{r['module_path']}/: {r['summary']}" + (f" (patterns: {', '.join(r['key_patterns'])})" if r["key_patterns"] else "") for r in modules)] if modules else []
        return "\n".join(parts)

    def _gathered(self, question: str, name: str) -> tuple[Navigation, str, list[str], str]:
        """(decision, context, files, confidence) for a question: files chosen, searched or summarised."""
        project = self._need(name)
        where, parts, files, sure = self.navigate(question, name), [], [], "medium"
        if where.needs_code:
            files = list(dict.fromkeys(where.target_files))[:10]
            parts.append(self.read_files(where.target_files + self.folder_files(where.target_folders, project), name))
            if len(where.target_files) < 2 and where.search_terms:
                more = self.retrieve_context(" ".join(where.search_terms), name)
                parts += ["=== ADDITIONAL SEARCH RESULTS ===\n" + more["context"]] if more["context"] else []
                files, sure = files + more["files"], more["confidence"]
        else:
            parts.append(self.summary_context(name))
        if any(w in question.lower() for w in fixed.AGGREGATE_WORDS):
            parts.append(self.aggregate_context(question, name))
        context = "\n\n".join(p for p in parts if p.strip())
        if not context:
            more = self.retrieve_context(question, name)
            context, files, sure = more["context"], more["files"], more["confidence"]
        return where, context or self.project_map(project), list(dict.fromkeys(files))[:10], sure

    def _prompt(self, question: str, context: str, session: str) -> str:
        history = self.session_history(session, 3) if session else []
        before = "\n---\n".join(f"Q: {r['question']}\nA: {r['answer']}" for r in history)
        return "\n\n".join(p for p in (before and f"Previous conversation:\n{before}", f"Question: {question}", f"Context from the codebase:\n{context}") if p)

    def answer(self, question: str, session: str = "", name: str = "") -> dict:
        """Navigate, gather context, ask the model, read more once if it asks for it, remember the turn."""
        project = self._need(name)
        where, context, files, sure = self._gathered(question, name)
        prompt = self._prompt(question, context, session)
        said = Answer.of(with_retry(lambda: self.model.complete(ANSWER, prompt, ANSWER_SCHEMA)), sure)
        if said.needs_more_context and said.additional_files:
            more = self.read_files(said.additional_files[:8], name)
            if more:
                again = with_retry(lambda: self.model.complete(ANSWER, f"{prompt}\n\nAdditional files you requested:\n{more}", ANSWER_SCHEMA))
                said = Answer.of(again, sure) if again else said
                files = files + said.relevant_files
        if not said.answer:
            said.answer = with_retry(lambda: self.model.complete(ANSWER, prompt)) or "The model can't be asked at the moment; try again later."
        files = list(dict.fromkeys(files))[:10]
        if session:
            self.remember(session, question, said.answer, files)
        return {
            "answer": said.answer, "citations": said.citations, "relevant_files": files, "confidence": said.confidence, "follow_up": said.follow_up,
            "context_chars": len(context), "reasoning": where.reasoning, "session_id": session, "project_id": project,
        }

    def stream_answer(self, question: str, session: str = "", name: str = "") -> Iterator[StreamEvent]:
        """The answer as it comes, piece by piece; the last event has what answer() returns, with times and counts.

        A model without a stream method gives its whole answer as one piece. An error is the last event, and no turn is kept.
        """
        project = self._need(name)
        where, context, files, sure = self._gathered(question, name)
        prompt = self._prompt(question, context, session)
        ask = getattr(self.model, "stream", None)
        pieces = ask(ANSWER, prompt) if ask else iter([with_retry(lambda: self.model.complete(ANSWER, prompt)) or ""])
        for event in streamed(pieces):
            if event.type == "done":
                said = Answer.of(event.content, sure)
                files = list(dict.fromkeys(files + said.relevant_files))[:10]
                event.content = said.answer
                event.metadata = event.metadata | {
                    "citations": said.citations, "relevant_files": files, "confidence": said.confidence, "follow_up": said.follow_up,
                    "reasoning": where.reasoning, "session_id": session, "project_id": project,
                }
                if session:
                    self.remember(session, question, said.answer, files)
            yield event

    def aggregate_context(self, question: str, name: str = "") -> str:
        """Categorised symbols by file."""
        low = question.lower()
        category = next((c for w, c in fixed.CATEGORY_WORDS if w in low), None)
        rows = self.query_categories(category, name)["rows"].where(~F.col("symbol_name").isin(*fixed.GENERIC_SYMBOLS))
        by = rows.groupBy("category", "rel_path").agg(F.slice(F.array_sort(F.collect_set("symbol_name")), 1, 10).alias("names")).orderBy("category", "rel_path")
        return "\n".join(["=== CATEGORIZED SYMBOLS ===", *(f"{r['category']}  {r['rel_path']}: [{', '.join(r['names'])}]" for r in by.limit(fixed.MAP_FILES).collect())])

    # ------------------------------------------------------------ sessions

    def remember(self, session: str, question: str, answer: str, files: list[str]) -> int:
        """Append a turn."""
        log = self._table("sessions", session)
        row = M.next_turn(log, "session_id").first()
        turn = row["next_turn"] if row else 0
        schema = "session_id string, turn_index bigint, question string, answer string, relevant_files array<string>, created_at double"
        self.store.append("sessions", session, self.spark.createDataFrame([(session, turn, question, answer, files, time.time())], schema))
        return turn

    def session_history(self, session: str, n: int = 50) -> list[dict]:
        """The last n turns, oldest first."""
        return [r.asDict() for r in M.tail(self._table("sessions", session), "session_id", n).orderBy("turn_index").collect()]
