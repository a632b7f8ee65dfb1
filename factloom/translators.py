"""Translators: from chunks to statements and from questions to goals.

A translator has statements(chunks), chunks being doc_id, chunk_no, chunk, which returns doc_id, chunk_no, stmt; and
goals(question), which returns goals in order. It may have support(question), statements that the question needs,
retry(question, tried), goals of a second stage, chunks(texts), its own way to cut texts, and reset().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import canonical_phrase
from factloom.operators import atoms, chunk, extract, planner, postprocess
from factloom.session import materialize

if TYPE_CHECKING:
    import pandas as pd

STATEMENTS = "doc_id long, chunk_no int, stmt string"
EXTRACTIONS = "doc_id long, chunk_no int, seq int, cls string, attributes map<string,string>, arguments array<string>, alignment string"


class Translator(Protocol):
    def statements(self, chunks: DataFrame) -> DataFrame: ...

    def goals(self, question: str) -> list[str]: ...


class PatternTranslator:
    """Deterministic translator of simple English sentences: 'X is a Y', 'X is part of Y', 'X is used for Y' and the like."""

    PATTERNS = (
        ("PartOf", r"^(?:the |an? )?(.+?) (?:is|are) part of (?:the |an? )?(.+?)[.]?$"),
        ("UsedFor", r"^(?:the |an? )?(.+?) (?:is|are) used for (.+?)[.]?$"),
        ("CapableOf", r"^(?:the |an? )?(.+?) (?:is|are) capable of (.+?)[.]?$"),
        ("AtLocation", r"^(?:the |an? )?(.+?) (?:is|are) located (?:in|at) (?:the |an? )?(.+?)[.]?$"),
        ("HasA", r"^(?:the |an? )?(.+?) has (?:the |an? )?(.+?)[.]?$"),
        ("IsA", r"^(?:the |an? )?(.+?) (?:is|are) (?:an? )?(.+?)[.]?$"),
    )

    def statements(self, chunks: DataFrame) -> DataFrame:
        text = F.lower(F.trim("chunk"))
        out = None
        for head, p in self.PATTERNS:
            atom = F.concat(F.lit(f"({head} "), canonical_phrase(F.regexp_extract(text, p, 1)), F.lit(" "), canonical_phrase(F.regexp_extract(text, p, 2)), F.lit(")"))
            out = F.when(text.rlike(p), atom) if out is None else out.when(text.rlike(p), atom)
        rows = chunks.withColumn("atom", out).where(F.col("atom").isNotNull())
        name = F.concat(F.lit("s_"), F.substring(F.md5("atom"), 1, 10))
        return rows.select("doc_id", "chunk_no", F.concat(F.lit("(: "), name, F.lit(" "), F.col("atom"), F.lit(" (STV 1.0 1.0))")).alias("stmt"))

    def goals(self, question: str) -> list[str]:
        return []


class ExternalTranslator:
    """A Python function from a list of chunks to a list of statements each, run per batch in the tasks, and one from a
    question to its goal or goals."""

    def __init__(self, translate: Callable[[list[str]], list[list[str]]], goal: Callable[[str], str | list[str] | None]) -> None:
        self.translate, self.goal = translate, goal

    def statements(self, chunks: DataFrame) -> DataFrame:
        translate = self.translate

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pandas as pd

            for pdf in it:
                made = translate(pdf["chunk"].tolist())
                rows = [(d, n, s) for d, n, part in zip(pdf["doc_id"], pdf["chunk_no"], made) for s in part]
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "stmt"])

        return chunks.select("doc_id", "chunk_no", "chunk").mapInPandas(run, STATEMENTS)

    def goals(self, question: str) -> list[str]:
        found = self.goal(question)
        return [found] if isinstance(found, str) else list(found or [])


class CanonicalTranslator:
    """Another translator's statements and goals brought into canonical form, chunk by chunk (R10, R11)."""

    def __init__(self, generator: Translator, context: Callable[[], list[str]] = list) -> None:
        self.generator, self.context = generator, context

    def statements(self, chunks: DataFrame) -> DataFrame:
        made = self.generator.statements(chunks).withColumn("k", F.monotonically_increasing_id())
        per_chunk = made.groupBy("doc_id", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "stmt"))), lambda x: x["stmt"]).alias("items"))  # those of one chunk
        known = F.array(*map(F.lit, self.context())).cast("array<string>")
        rows = chunks.select("doc_id", "chunk_no", "chunk").join(per_chunk, ["doc_id", "chunk_no"])
        return rows.select("doc_id", "chunk_no", F.explode(postprocess.statements(F.col("chunk"), F.col("items"), known)).alias("stmt"))

    def goals(self, question: str) -> list[str]:
        made = self.generator.goals(question)
        spark = _session()
        row = spark.createDataFrame([(question, made, self.context())], "q string, g array<string>, c array<string>")
        return list(row.select(postprocess.goals(F.col("q"), F.col("g"), F.col("c")).alias("g")).first().g)


class ExtractionTranslator:
    """A Python function from chunks to extractions (dictionaries with cls, attributes, arguments, alignment), translated
    by columns; its chunks are whole paragraphs."""

    def __init__(self, extract_: Callable[[list[str]], list[list[dict]]], skip_fuzzy: bool = True) -> None:
        self.extract, self.skip_fuzzy = extract_, skip_fuzzy

    def chunks(self, texts: DataFrame) -> DataFrame:
        return chunk.document_paragraphs(texts)

    def extractions(self, chunks: DataFrame) -> DataFrame:
        extract_ = self.extract

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pandas as pd

            for pdf in it:
                made = extract_(pdf["chunk"].tolist())
                rows = [
                    (d, n, k, e.get("cls"), {a: str(b) for a, b in (e.get("attributes") or {}).items() if b is not None}, e.get("arguments") or [], e.get("alignment"))
                    for d, n, part in zip(pdf["doc_id"], pdf["chunk_no"], made)
                    for k, e in enumerate(part)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "seq", "cls", "attributes", "arguments", "alignment"])

        found = chunks.select("doc_id", "chunk_no", "chunk").mapInPandas(run, EXTRACTIONS)
        spelled = chunks.select("doc_id", "chunk_no", extract.proper_spellings(F.col("chunk")).alias("proper"))
        return found.join(spelled, ["doc_id", "chunk_no"])

    def translated(self, chunks: DataFrame) -> DataFrame:
        """Extractions with their statement or the reason there is none."""
        return extract.translate(self.extractions(chunks), self.skip_fuzzy, proper="proper")

    def statements(self, chunks: DataFrame) -> DataFrame:
        made = self.translated(chunks).where(F.col("stmt").isNotNull())
        return made.groupBy("doc_id", "chunk_no", "stmt").agg(F.min("seq").alias("seq")).select("doc_id", "chunk_no", "stmt")

    def goals(self, question: str) -> list[str]:
        spark = _session()
        one = spark.createDataFrame([(0, 0, question)], "doc_id long, chunk_no int, chunk string")
        rows = extract.goals(self.extractions(one), proper="proper").where("goal is not null").orderBy("seq").select("goal").collect()  # of one question
        return list(dict.fromkeys(r.goal for r in rows))


class HybridTranslator:
    """The first translator's statements, chunk by chunk; the second's where the first gives none, or gives symbols that
    read like copied phrases while the second gives some. Goals of both, in the order of the mode: 'first', 'second' or
    'second_only', where the first is asked when no goal of the second was proved."""

    MODES = ("first", "second", "second_only")

    def __init__(self, first: Translator, second: Translator, mode: str = "first") -> None:
        if mode not in self.MODES:
            mode = "first"
        self.first, self.second, self.mode = first, second, mode

    def chunks(self, texts: DataFrame) -> DataFrame:
        return self.first.chunks(texts) if hasattr(self.first, "chunks") else chunk.document_chunks(texts)

    def statements(self, chunks: DataFrame) -> DataFrame:
        a = materialize(self.first.statements(chunks), "first-statements")
        b = materialize(self.second.statements(chunks), "second-statements")
        key = ["doc_id", "chunk_no"]
        literal = a.where(atoms.overliteral(F.col("stmt"))).select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi")
        kept = a.join(literal, key, "left_anti")
        return kept.unionByName(b.join(kept.select(*key).distinct(), key, "left_anti"))

    def goals(self, question: str) -> list[str]:
        if self.mode == "second_only":
            return self.second.goals(question)
        both = (self.first, self.second) if self.mode == "first" else (self.second, self.first)
        return list(dict.fromkeys(g for t in both for g in t.goals(question)))

    def retry(self, question: str, tried: str) -> list[str]:
        return self.first.goals(question) if self.mode == "second_only" else []

    def reset(self) -> None:
        for t in (self.first, self.second):
            if hasattr(t, "reset"):
                t.reset()


class MergingTranslator:
    """A translator whose statements and goals come in two lists, as statements and as further expressions, merged in
    order, each once (U7)."""

    def __init__(self, main: Translator, further: Translator) -> None:
        self.main, self.further = main, further

    def statements(self, chunks: DataFrame) -> DataFrame:
        return self.main.statements(chunks).unionByName(self.further.statements(chunks)).distinct()

    def goals(self, question: str) -> list[str]:
        return list(dict.fromkeys([*self.main.goals(question), *self.further.goals(question)]))


class RememberingTranslator:
    """Keeps the predicates that a translator has used, each with its first use, over calls until reset (X2)."""

    def __init__(self, inner: Translator) -> None:
        self.inner, self.heads = inner, {}

    def statements(self, chunks: DataFrame) -> DataFrame:
        made = materialize(self.inner.statements(chunks), "remembered")
        heads = made.select(F.explode(atoms.context_heads(F.array("stmt"))).alias("h"), "doc_id", "chunk_no").groupBy("h").agg(F.min(F.struct("doc_id", "chunk_no")).alias("at"))
        for r in heads.orderBy("at", "h").toLocalIterator():  # a vocabulary of predicates
            self.heads.setdefault(r.h, len(self.heads))
        return made

    def goals(self, question: str) -> list[str]:
        return self.inner.goals(question)

    def reset(self) -> None:
        self.heads.clear()


def pattern_goals(question: str) -> list[str]:
    """Goals of a question by the question patterns."""
    row = _session().range(1).select(planner.pattern_goals(F.lit(question)).alias("g")).first()
    return list(row.g)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


#: Translators by name; those that need functions of the caller's take them as arguments.
TRANSLATORS: dict[str, Callable[..., Translator]] = {
    "pattern": PatternTranslator,
    "external": ExternalTranslator,
    "canonical": lambda generator=None, **k: CanonicalTranslator(generator or PatternTranslator(), **k),
    "extraction": ExtractionTranslator,
    "hybrid": HybridTranslator,
    "merging": MergingTranslator,
    "remembering": RememberingTranslator,
}


def translator(name: str, *args, **kwargs) -> Translator:
    """A translator by name; unknown names raise."""
    if name not in TRANSLATORS:
        raise ValueError(f"unknown translator {name!r}; known are {', '.join(TRANSLATORS)}")
    return TRANSLATORS[name](*args, **kwargs)
