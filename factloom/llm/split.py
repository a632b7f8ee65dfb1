"""Problem 3: splitting oversized texts at natural boundaries, by bounded-quantifier regex extraction.

A text is consumed by one regular expression per size limit, whose alternatives are ordered by the strength of the
boundary they end at: the rest of the text, a blank line, a sentence end, a line break, a clause mark, white space,
any character. Strong boundaries count only in the upper half of the limit, so that pieces do not get tiny. The
extracted bodies do not overlap and together are the text; the overlap is looked back for over earlier bodies with
array functions. Everything is a Column expression: no shuffle and no Python.

Defined cases: white space at both ends is dropped first; NULL text, NULL or non-positive size gives NULL; a blank
text gives no piece; a NULL or negative overlap counts as 0 and one of size or more as size - 1; a text no longer
than the size is its only piece. A boundary is seen behind up to 64 white-space characters. Lengths are Unicode characters; a cut never parts a combining mark from its base
unless the marks alone exceed the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four information separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
CLOSE = r"[\"'”’»」』）)\]]"


def trimmed(text: Column) -> Column:
    """White space dropped at both ends, in time linear in the text's length."""
    return F.regexp_replace(text, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z|\A{SPACE}+\z", "")


def _alternatives(limit: Column) -> Column:
    """The body pattern for a limit: 'consume up to the limit' with one alternative per kind of boundary."""
    high = limit.cast("string")
    low = F.greatest(F.lit(1), F.floor(limit / 2)).cast("string")
    upper = F.concat(F.lit("[\\s\\S]{"), low, F.lit(","), high, F.lit("}"))
    whole = F.concat(F.lit("[\\s\\S]{1,"), high, F.lit("}"))
    return F.concat_ws(
        "|",
        F.concat(whole, F.lit(r"\z")),
        F.concat(upper, F.lit(r"(?<=\n)(?<=\n[ \t\r]{0,64}\n)")),
        F.concat(upper, F.lit(rf"(?<=[\s。！？｡]|{CLOSE})(?<=[.!?…؟।]{CLOSE}{{0,3}}\s{{1,64}}|[。！？｡]{CLOSE}{{0,3}})(?!{CLOSE}|\s)")),
        F.concat(upper, F.lit(r"(?<=\n)")),
        F.concat(upper, F.lit(r"(?<=[\s，；：、])(?<=[,;:،؛]\s{1,64}|[，；：、])(?!\s)")),
        F.concat(whole, F.lit(rf"(?<={SPACE})")),
        F.concat(whole, F.lit(r"(?![\p{M}‍︎️])(?<!‍)")),
        whole,
    )


def pieces(text: Column, size: Column, overlap: Column) -> Column:
    """Array of the pieces of a text: each at most size characters, each but the first starting with the last
    overlap characters before it (all there are, where there are fewer)."""
    size = size.cast("int")
    over = F.least(F.greatest(F.coalesce(overlap.cast("int"), F.lit(0)), F.lit(0)), size - 1)
    body = trimmed(text)
    pattern = F.concat(F.lit("\\A(?:"), _alternatives(size), F.lit(")|(?:"), _alternatives(size - over), F.lit(")"))
    # a text that fits needs no pattern: its own is compiled once and takes all of it
    pattern = F.when(F.length(body) <= size, F.lit(r"\A[\s\S]+\z")).otherwise(pattern)
    bodies = F.regexp_extract_all(body, pattern, F.lit(0))

    def with_lookback(all_: Column, part: Column, i: Column) -> Column:
        back = F.least(i, over)  # a body has at least one character
        before = F.array_join(F.slice(all_, i - back + 1, back), "")
        return F.when(back < 1, part).otherwise(F.concat(F.right(before, over), part))

    # the outer array binds the bodies to a name, so that they are extracted once and not once per piece
    joined = F.transform(F.array(bodies), lambda all_: F.transform(all_, lambda part, i: with_lookback(all_, part, i)))
    return F.when((size > 0) & text.isNotNull(), joined[0])


def split_texts(texts: DataFrame, text: str, size: str, overlap: str, out: str = "pieces") -> DataFrame:
    """Adds the array of pieces; rows keep their partition."""
    return texts.withColumn(out, pieces(F.col(text), F.col(size), F.col(overlap)))


def oversized_requests(requests: DataFrame, settings: DataFrame, keep_text: bool = False) -> DataFrame:
    """request_id, text_no, chunk_size, chunk_overlap and pieces (and the text, on request) of each entry of texts that its request's setting makes too long.

    Redelivered requests count once. settings is a small fixed table, which Spark broadcasts below its threshold
    and joins by shuffle above it. Only narrow keys are shuffled.
    """
    setting = settings.select("setting_id", "chunk_size", "chunk_overlap").dropDuplicates(["setting_id"])
    entries = requests.select("request_id", "setting_id", F.posexplode("texts").alias("text_no", "text")).where(
        F.col("text").isNotNull()
    )
    cut = split_texts(entries.join(setting, "setting_id"), "text", "chunk_size", "chunk_overlap")
    return cut.where(F.size("pieces") > 1).select("request_id", "text_no", "chunk_size", "chunk_overlap", "pieces", *(["text"] if keep_text else []))
