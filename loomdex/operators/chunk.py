"""Line spans, structural chunks, links and tags. Spans are half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import starts


def line_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, pos, char_start, char_end, line`` of every line, empty ones included. In the row: no shuffle, and
    rows that share an id have their own offsets."""
    lines = docs.select(id_col, *keep, F.split(text_col, "\n").alias("_lines"))
    at = F.expr(starts("transform(_lines, x -> length(x) + 1)"))
    rows = lines.select(id_col, *keep, F.posexplode(F.arrays_zip(at.alias("at"), F.col("_lines").alias("line"))).alias("pos", "_x"))
    begin = F.col("_x.at").cast("long")
    return rows.select(id_col, *keep, "pos", F.col("_x.line").alias("line"), (begin + F.length("_x.line")).alias("char_end"), begin.alias("char_start"))


def line_kind(line: Column) -> Column:
    """A line's block kind by its own look, in the scanner's order of precedence."""
    blank = F.trim(line) == ""
    return (
        F.when(blank, "blank")
        .when(line.rlike(r"^ {0,3}#{1,6}([ \t]|$)"), "heading")
        .when(line.rlike(r"^ {0,3}(```|~~~)"), "fenced_code")
        .when(line.rlike(r"^(    |\t)"), "indented_code")
        .when(line.rlike(r"^ {0,3}\|.*\|[ \t]*$"), "table")
        .when(line.rlike(r"^ {0,3}([-+*]|[0-9]{1,9}[.)])[ \t]+\S"), "list")
        .when(line.rlike(r"^ {0,3}>"), "blockquote")
        .when(line.rlike(r"^ {0,3}(\*[ \t]*\*[ \t]*\*[*\t ]*|-[ \t]*-[ \t]*-[- \t]*|_[ \t]*_[ \t]*_[_ \t]*)$"), "thematic_break")
        .when(line.rlike(r"^ {0,3}<[A-Za-z/!?]"), "html")
        .otherwise("paragraph")
    )


def greedy_chunks(blocks: DataFrame, by: list[str], target: int = 4000) -> DataFrame:
    """Pack blocks (char_start, char_end, ordered) of each group while the chunk spans at most ``target``.

    One fold over a group's blocks, which are one section's and so bounded by a document.
    """
    spans = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("b"))
    fold = F.expr(f"""aggregate(b, cast(array() as array<struct<char_start:bigint,char_end:bigint,n_blocks:bigint>>), (acc, x) ->
        if(size(acc) > 0 AND x.char_end - element_at(acc, -1).char_start <= {int(target)},
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('char_start', element_at(acc, -1).char_start, 'char_end', x.char_end, 'n_blocks', element_at(acc, -1).n_blocks + 1L))),
            concat(acc, array(named_struct('char_start', x.char_start, 'char_end', x.char_end, 'n_blocks', 1L)))))""")
    out = spans.select(*by, F.posexplode(fold).alias("ordinal", "c"))
    return out.select(*by, F.col("ordinal").cast("long").alias("ordinal"), "c.*")


def hard_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 12000) -> DataFrame:
    """Pieces of at most ``most`` characters, cut behind the last newline in reach, else at the limit.

    Each cut depends on the one before it, so this is a loop over a text in an Arrow batch.
    """
    import pyarrow as pa

    def cut(text: str) -> list[int]:
        ends = [0]
        while ends[-1] < len(text):
            reach = ends[-1] + most
            ends.append(len(text) if reach >= len(text) else (text.rfind("\n", ends[-1], reach) + 1 or reach))
        return ends

    def split(batches):
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                at = cut(text or "")
                ids += [i] * (len(at) - 1)
                starts += at[:-1]
                ends += at[1:]
            yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[id_col, "char_start", "char_end"])

    return docs.select(id_col, text_col).mapInArrow(split, f"{id_col} {dict(docs.dtypes)[id_col]}, char_start long, char_end long")


def role(kinds: Column) -> Column:
    """A chunk of headings and rules only is an anchor for structure, not evidence."""
    return F.when(F.forall(kinds, lambda k: k.isin("heading", "thematic_break")), "structural_anchor").otherwise("content_evidence")


def links(text: Column) -> Column:
    """All wiki links of a text as (embed, path, heading, block, alias), to the letter as ``parse`` has them; absent parts are null."""
    raw = F.regexp_extract_all(text, F.lit(r"!?\[\[[^\]\n]+\]\]"), 0)
    some = lambda x: F.when(x != "", x)

    def split(x: Column) -> Column:
        inner = F.regexp_replace(x, r"^!?\[\[|\]\]$", "")
        target, alias = F.split_part(inner, F.lit("|"), F.lit(1)), F.when(F.contains(inner, F.lit("|")), F.regexp_replace(inner, r"^[^|]*\|", ""))
        path, heading = F.split_part(target, F.lit("#"), F.lit(1)), F.when(F.contains(target, F.lit("#")), F.regexp_replace(target, r"^[^#]*#", "")).otherwise("")
        inside = F.contains(heading, F.lit("^"))
        block = F.regexp_replace(F.when(inside, heading).otherwise(path), r"^[^^]*\^?", "")
        return F.struct(F.startswith(x, F.lit("!")).alias("embed"), some(F.when(inside, path).otherwise(F.split_part(path, F.lit("^"), F.lit(1)))).alias("path"), some(F.split_part(heading, F.lit("^"), F.lit(1))).alias("heading"), some(block).alias("block"), alias.alias("alias"))

    return F.transform(raw, split)


def tags(text: Column) -> Column:
    """Hash tags that no word character, slash or bracket precedes, as they are written."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w/\[])#([^\s#.,;:!?()\[\]{}]+)"), 1)
