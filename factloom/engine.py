"""Engine: ingest texts, answer questions, reset and report health over one folder of tables (SURVEY §2.14, S2-S3, S14,
K1-K8, L3, L5-L6, R1, R4-R8, R12-R17, X3-X4, H14, H16)."""

from __future__ import annotations

import os
import threading
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import atoms, chunk, kb, metrics, planner, postprocess, reasoner, report, triples, vectors
from factloom.session import materialize
from factloom.translators import TRANSLATORS, ExternalTranslator, HybridTranslator, PatternTranslator, Translator, translator

__all__ = ["TRANSLATORS", "Engine", "ExternalTranslator", "HybridTranslator", "PatternTranslator", "Translator"]

FACTS = "stmt string, body string, name string, kind string, head string, args array<string>, arity int, tv struct<s:double,c:double>, dist array<struct<x:double,w:double>>, canon_key string, seq long"
VECTORS = "record_id long, nl string, pln array<string>, vector array<float>, source string"
BACKGROUND = "conceptnet"
#: Answers that a response shows; goal() gives all.
SHOWN = 100


class Engine:
    """One knowledge base: a folder with the tables statements, background and vectors."""

    def __init__(
        self, spark: SparkSession, path: str, translator_: str | Translator = "pattern", dimensions: int = 64, *, fallback: bool = True,
        max_tries: int = 0, source_atoms: int = 0, context_size: int = 50, top_k: int = 10, timeout: float | None = None, answers: bool = True,
    ) -> None:
        self.spark, self.path, self.dimensions = spark, path, dimensions
        self.translator = translator(translator_) if isinstance(translator_, str) else translator_
        self.fallback, self.max_tries, self.source_atoms = fallback, max_tries, source_atoms
        self.context_size, self.top_k, self.timeout, self.with_answers = context_size, top_k, timeout, answers
        self.last_error, self.skipped_rules = "", []

    # Tables.

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _exists(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _remove(self, name: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def facts(self) -> DataFrame:
        """The statements that were added."""
        return self._read("statements", FACTS)

    def background(self) -> DataFrame:
        return self._read("background", FACTS)

    def known(self) -> DataFrame:
        """Added and background statements; background comes later in every order."""
        later = self.background().withColumn("seq", F.col("seq") + F.lit(1 << 60))
        return self.facts().unionByName(later)

    def stored(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    # Statements.

    def add(self, statements: DataFrame) -> DataFrame:
        """Appends statements(stmt); returns the rejected ones. seq follows the order of arrival by batches."""
        return self._added(statements)[0]

    def _added(self, statements: DataFrame) -> tuple[DataFrame, int]:
        made = materialize(statements.select("stmt"), "made-statements")
        good, bad = kb.accept(made)
        begin = self.facts().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        good = materialize(good.withColumn("seq", F.monotonically_increasing_id() + begin), "new-statements")
        good.write.mode("append").parquet(f"{self.path}/statements")
        return bad, good.count()

    def ingest(self, texts: DataFrame | list[str]) -> DataFrame:
        """texts(doc_id, text) or a list of strings; one row with the counters of the call."""
        if isinstance(texts, list):
            texts = self.spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        units, made = self._translated(texts)
        bad, added = self._added(made)
        self.index(units.select(F.col("chunk").alias("nl")))
        row = (units.count(), added, bad.count(), "success" if added else "failed")
        return self.spark.createDataFrame([row], "chunk_count long, added long, rejected_count long, status string")

    def _translated(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        cut = self.translator.chunks(texts) if hasattr(self.translator, "chunks") else chunk.document_chunks(texts)
        units = materialize(cut, "chunks")
        return units, materialize(self.translator.statements(units), "translated")

    def ingest_items(self, texts: DataFrame) -> DataFrame:
        """As ingest, with a row of counters per text: chunk_count, batch_count, statements, rejected ones and the first
        three of them, and status (A7, A8, L9)."""
        units, made = self._translated(texts)
        checked = materialize(atoms.validate(made), "checked")
        self._added(checked.where("reason is null"))
        self.index(units.select(F.col("chunk").alias("nl")))
        return metrics.ingest_counters(units, checked)

    def index(self, records: DataFrame, source: str = "user") -> int:
        """Stores records(nl, optional pln) with their vectors; returns their number."""
        rows = records if "pln" in records.columns else records.withColumn("pln", F.array().cast("array<string>"))
        rows = materialize(rows.select(F.xxhash64("nl").alias("record_id"), "nl", "pln", F.lit(source).alias("source")), "records")
        vectors.store(rows, f"{self.path}/vectors", self.dimensions)
        return rows.count()

    def delete_by_source(self, source: str) -> None:
        """Removes the stored records of a source: its folder, as records are partitioned by source."""
        self._remove(f"vectors/source={source}")

    # Background knowledge.

    def load_background(self, statements: DataFrame) -> bool:
        """Makes statements(stmt) background knowledge, apart from what is added. Once loaded it is not loaded again until
        a reset; returns whether it was."""
        if self._exists("background"):
            return False
        good, _ = kb.accept(statements.select("stmt"))
        good.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/background")
        return True

    def load_triples(self, rows: DataFrame, min_weight: float = 2.0, coverage_percent: float = 100.0, seed: int = 42, index: bool = True, force: bool = False) -> dict:
        """Background knowledge from raw triples: exported, loaded and, where the index is empty or incomplete, indexed.
        What a new export replaces is removed first. Returns the progress (R14, R15, X3)."""
        if force:
            self._remove("background")
            self.delete_by_source(BACKGROUND)
        emitted = materialize(triples.export(rows, min_weight, coverage_percent, seed), "background-export")
        loaded = self.load_background(emitted.select(F.col("atom").alias("stmt")))
        expected = emitted.count()
        existing = self.stored().where(F.col("source") == BACKGROUND).count()
        if index and not (existing > 0 and existing >= expected):
            self.delete_by_source(BACKGROUND)
            existing = self.index(emitted.select("nl", "pln"), BACKGROUND)
        return {"loaded": loaded, "indexed_count": existing, "expected_count": expected, "last_error": self.last_error}

    # Questions.

    def retrieve(self, question: str, k: int | None = None) -> DataFrame:
        """The k stored records nearest to a question."""
        wanted = self.spark.createDataFrame([(0, question)], "record_id long, nl string").withColumn("vector", vectors.hashing_embedder(self.dimensions)(F.col("nl")))
        found = vectors.top_k(self.stored(), wanted, k or self.top_k, "record_id", "vector")
        return found.join(self.stored().select("record_id", "nl", "pln").dropDuplicates(["record_id"]), "record_id").select("rank", "score", "nl", "pln").orderBy("rank")

    def context(self, n: int | None = None, question: str | None = None) -> DataFrame:
        """The last n distinct statements: those of the knowledge base in order, then those of the records nearest to the
        question. A retrieved statement that was added before keeps its early place."""
        rows = self.facts().select("stmt", F.lit(0).alias("part"), "seq")
        if question is not None and self._exists("vectors"):
            near = self.retrieve(question).select(F.posexplode("pln").alias("k", "stmt"), "rank")
            rows = rows.unionByName(near.select("stmt", F.lit(1).alias("part"), (F.col("rank") * 1000 + F.col("k")).cast("long").alias("seq")))
        return vectors.last_distinct(rows.select("stmt", F.struct("part", "seq").alias("seq")), "stmt", "seq", n or self.context_size)

    def rules(self) -> list[reasoner.Rule]:
        """Rules of the knowledge base; statements that are no usable rule are noted and skipped."""
        out: list[reasoner.Rule] = []
        self.skipped_rules = []
        for row in self.known().where(F.col("kind") == "rule").select("stmt").toLocalIterator():
            try:
                out += reasoner.parse_rule(row.stmt)
            except (ValueError, KeyError, IndexError) as e:
                self.skipped_rules.append((row.stmt, str(e)))
        return out

    def _base(self) -> DataFrame:
        """Facts with truth values; a distribution says nothing about truth, so it is certain that the fact has it."""
        return self.known().where(F.col("kind") == "fact").select("head", "args", F.coalesce("tv.s", F.lit(1.0)).alias("s"), F.coalesce("tv.c", F.lit(1.0)).alias("c"), "dist")

    def goal(self, goal: str, max_rounds: int | None = None) -> DataFrame:
        """Bindings of a goal: facts first, by exact and then by canonical arguments for ground goals, else the fixpoint of
        the rules from which its predicate can be reached."""
        wanted = reasoner.goal_atom(goal)
        base = self._base()
        direct = reasoner.answers(base, goal)
        if not direct.isEmpty():
            return direct
        if not wanted.variables:
            asked = self.spark.createDataFrame([(0, goal)], "goal_id long, goal string")
            key = kb.lookup_canonical(asked, self.known().where(F.col("kind") == "fact")).where("proof is not null")
            if not key.isEmpty():
                return kb.parse_statements(key.select(F.col("proof").alias("stmt"))).select(F.coalesce("tv.s", F.lit(1.0)).alias("s"), F.coalesce("tv.c", F.lit(1.0)).alias("c"), "dist")
        rules = []
        for rule in reasoner.relevant(self.rules(), reasoner.stored_head(wanted)):
            try:
                reasoner.bindings(rule, [base] * len(rule.premises), base)
                rules.append(rule)
            except ValueError as e:
                self.skipped_rules.append((rule.name, str(e)))
        return reasoner.answers(reasoner.fixpoint(base, rules, max_rounds), goal) if rules else direct

    def prove(self, goal: str) -> tuple[list[dict], int]:
        """The first answers of a goal in order of their columns, and the number of all; none where the search fails or
        takes longer than the timeout, which is noted as last error (R1)."""
        context = self.spark.sparkContext
        group = f"goal-{uuid.uuid4().hex}"
        timer = threading.Timer(self.timeout, lambda: context.cancelJobGroup(group)) if self.timeout else None
        context.setJobGroup(group, goal[:100], interruptOnCancel=True)
        if timer:
            timer.start()
        try:
            found = materialize(self.goal(goal), "answers")
            columns = [c for c in found.columns if c != "dist"]
            rows = found.orderBy(*[F.col(f"`{c}`") for c in columns]).limit(SHOWN).collect()
            return [r.asDict(recursive=True) for r in rows], found.count()
        except Exception as e:
            self.last_error = f"{type(e).__name__}: {str(e)[:300]}"
            return [], 0
        finally:
            if timer:
                timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def plan(self, question: str, context: list[str]) -> tuple[str, list[str]]:
        """The original goal and the ranked candidates of a question: the translator's goals in canonical form, or else
        those of the question patterns, planned against the facts and conclusions of the context."""
        made = self.translator.goals(question)
        row = self.spark.createDataFrame([(question, made, context)], "q string, g array<string>, c array<string>")
        known = row.select(
            postprocess.goals(F.col("q"), F.col("g"), F.col("c")).alias("goals"),
            planner.pattern_goals(F.col("q")).alias("patterns"),
            F.flatten(F.transform("c", atoms.fact_atoms)).alias("facts"),
            F.flatten(F.transform("c", atoms.conclusion_atoms)).alias("conclusions"),
        ).first()
        goals = list(known.goals) or list(known.patterns)[:1]
        if not goals:
            return "", []
        asked = self.spark.createDataFrame([(i, question, g) for i, g in enumerate(goals)], "goal_id long, question string, goal string")
        found = [("fact", a) for a in known.facts] + [("conclusion", a) for a in known.conclusions]
        flat = self.spark.createDataFrame(found, "kind string, atom string").withColumn("sig", atoms.parse_flat(F.col("atom")))
        signatures = flat.where("sig is not null").select("kind", "sig.head", "sig.args")
        ranked = planner.plan(asked, signatures).orderBy("rank").select("goal").collect()  # of one question and its context
        return goals[0], [r.goal for r in ranked] or goals[:1]

    def query(self, question: str, support: DataFrame | None = None) -> dict:
        """Answers a question: context, candidates, proofs until one is found, a second stage where the translator has one,
        status, sources and an answer text, with the time of each step. answers are the first SHOWN in order of their
        columns, answer_count is the number of all. Support statements are stored first, where given."""
        clock = [time.perf_counter()]

        def lap() -> float:
            clock.append(time.perf_counter())
            return round(clock[-1] - clock[-2], 4)

        context = [r.stmt for r in self.context(question=question).orderBy("seq").select("stmt").collect()]  # at most context_size
        out: dict = {"question": question, "original_query": "", "executed_query": "", "fallback_used": False, "query_status": "no_query", "answers": [], "answer_count": 0, "sources": []}
        out["context_retrieval_seconds"] = lap()
        original, candidates = self.plan(question, context)
        out["parse_query_seconds"] = lap()
        if not candidates:
            return out | {"status": "no_query", "answer": report.UNTRANSLATED, "candidate_count": 0, "candidate_count_tried": 0, "executed_candidate_index": None, "retry_used": False, "reasoning_seconds": 0.0, "source_lookup_seconds": 0.0, "answer_generation_seconds": 0.0}
        if support is None and hasattr(self.translator, "support"):
            lines = self.translator.support(question)
            support = self.spark.createDataFrame([(s,) for s in lines], "stmt string") if lines else None
        if support is not None:
            self.add(support)

        def capped(goals: list[str], tried: int) -> list[str]:
            if not self.fallback:
                return goals[:1]
            return goals[: max(0, self.max_tries - tried)] if self.max_tries else goals

        total, todo, tried, index, executed, answers, count, retried = len(candidates) if self.fallback else 1, capped(candidates, 0), 0, None, "", [], 0, False
        tried = len(todo)
        while True:
            for executed in todo:
                index = 0 if index is None else index + 1
                answers, count = self.prove(executed)
                if count:
                    break
            if count or retried or not hasattr(self.translator, "retry"):
                break
            more = self.translator.retry(question, executed)
            retried = bool(more)
            if not more:
                break
            total += len(more) if self.fallback else 1
            todo = capped(more, tried)
            tried += len(todo)
        out["reasoning_seconds"] = lap()
        fallback_used = bool(executed and original and executed != original)
        status = self._status(original, question, fallback_used)
        if self.source_atoms and count:
            out["sources"] = self.sources(executed)
        out["source_lookup_seconds"] = lap()
        answer = report.answer_text(answers, count, status, enabled=self.with_answers)
        return out | {
            "original_query": original, "executed_query": executed, "fallback_used": fallback_used, "query_status": status, "status": status,
            "answers": answers, "answer_count": count, "answer": answer, "candidate_count": total, "candidate_count_tried": tried,
            "executed_candidate_index": index, "retry_used": retried, "answer_generation_seconds": lap(),
        }

    def _status(self, original: str, question: str, fallback_used: bool) -> str:
        row = self.spark.range(1).select(atoms.query_status(F.lit(original), F.lit(question), F.lit(fallback_used)).alias("s")).first()
        return row.s

    def sources(self, proof: str) -> list[str]:
        """Stored sentences nearest to the atoms of a proof."""
        proofs = self.spark.createDataFrame([(0, proof)], "proof_id long, proof string")
        points = self.stored().select(F.col("record_id").alias("vec_id"), F.col("vector").alias("embedding"), "nl")
        found = vectors.source_lookup(proofs, points, vectors.hashing_embedder(self.dimensions), atoms_per_proof=self.source_atoms)
        return sorted(r.nl for r in found.select("nl").distinct().collect())  # at most source_atoms

    def query_many(self, goals: DataFrame) -> DataFrame:
        """goals(goal_id, question, goal) of many questions at once: question, executed, proof, original, fallback_used and
        status. Candidates are planned against all known facts and conclusions and proved by lookup of stored facts."""
        known = materialize(self.known().select("stmt", "kind", "head", "args", "body", "canon_key", "seq"), "known")
        facts = known.where("kind = 'fact'")
        conclusions = known.where("kind = 'rule'").select(F.explode(atoms.conclusion_atoms(F.col("stmt"))).alias("a")).withColumn("sig", atoms.parse_flat(F.col("a")))
        signatures = facts.select("head", "args", F.lit("fact").alias("kind")).unionByName(conclusions.select("sig.head", "sig.args", F.lit("conclusion").alias("kind")))
        ranked = materialize(planner.cap_candidates(planner.plan(goals, signatures), self.max_tries, self.fallback).withColumn("goal_id", F.monotonically_increasing_id()), "ranked")
        proofs = kb.lookup(ranked.select("goal_id", "goal"), facts)
        first = goals.groupBy("question").agg(F.min_by("goal", "goal_id").alias("asked"))
        tried = planner.first_proved(ranked, proofs).join(first, "question")
        fallback = F.coalesce(F.col("executed") != F.col("asked"), F.lit(False))
        return tried.select("question", "executed", "proof", F.col("asked").alias("original"), fallback.alias("fallback_used"), atoms.query_status(F.col("asked"), F.col("question"), fallback).alias("status"))

    # Management.

    def reset(self, scope: str = "all", keep_background: bool = False) -> None:
        """Removes the statements ('atomspace'), the vectors ('vectordb') or both ('all'), and what the translator remembers
        with the statements. Background knowledge goes with them unless it is to be kept, as records of its source are."""
        parts = {"all": ("statements", "vectors"), "atomspace": ("statements",), "vectordb": ("vectors",)}[scope]
        for part in parts:
            if part == "vectors" and keep_background:
                kept = materialize(self.stored().where(F.col("source") == BACKGROUND), "kept-vectors")
                self._remove(part)
                kept.write.mode("append").partitionBy("source").parquet(f"{self.path}/vectors")
                continue
            self._remove(part)
        if "statements" in parts:
            if not keep_background:
                self._remove("background")
            if hasattr(self.translator, "reset"):
                self.translator.reset()
        self.last_error = ""

    def sizes(self) -> dict:
        """Numbers of statements, background statements, records and records by source (A3, A4, H16)."""
        by = {r.source: r.n for r in self.stored().groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # sources, not records
        return {"statements": self.facts().count(), "background": self.background().count(), "vectors": sum(by.values()), "by_source": by}

    def health(self) -> dict:
        sizes = self.sizes()
        return {"status": "degraded" if self.last_error else "ok", "statements": sizes["statements"], "background": sizes["background"], "vectors": sizes["vectors"], "last_error": self.last_error, "path": os.path.basename(self.path)}


def compare(spark: SparkSession, cases: list[dict], engines: dict[str, Engine], cumulative: bool = False) -> DataFrame:
    """Runs cases {name, texts, question, expected_proof} through engines by name: one result row per case and engine, in
    the form that metrics.parser_summary reads. Each case starts from an empty knowledge base unless cumulative (E10, X4)."""
    rows = []
    for name, engine in engines.items():
        engine.reset()
        for case in cases:
            if not cumulative:
                engine.reset()
            began = time.perf_counter()
            engine.ingest(list(case["texts"]))
            ingested = time.perf_counter()
            got = engine.query(case["question"])
            rows.append((name, case["name"], got["answer_count"] > 0, case.get("expected_proof"), got["query_status"], got["fallback_used"], got["original_query"], got["executed_query"], time.perf_counter() - began, ingested - began, time.perf_counter() - ingested))
    return spark.createDataFrame(rows, "parser string, name string, proof_found boolean, expected boolean, status string, fallback_used boolean, original_query string, executed_query string, seconds double, ingest_seconds double, query_seconds double")
