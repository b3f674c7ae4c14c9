"""Line deduplication by winnowing over line hashes.

A window is a run of non-blank lines with at least min_words words from which no end line can be spared. The smallest
line hash of each window is selected, once for each line that it falls on, so two documents that share such a run have
selected the same line of it: these positions are the fingerprints. They are joined on their hash; around every
position that has met another, the match is extended to both sides, up to the ends of the windows that selected it.
All members of a group are extended at once, each by its own lines, and told apart by what the extension adds, so a
group costs as many rows as it has members. Overlapping matches make up a whole repeated run; later ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import WORD, let, spare, text_or_empty, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bits(min_words: int) -> int:
    """Bits that hold the number of lines before or behind another in a window: each line has a word at least."""
    return max(1, (min_words - 1).bit_length())


def _windows(lines: Column, min_words: int) -> Column:
    """Every window of an array of lines with words n, once: its place (that of its least hash), the lines before it and the lines after its first, packed into a long."""
    bits = _bits(min_words)

    def ends(step: int):
        def at(j: Column) -> Column:
            words, end = F.get(lines, j)["n"], None
            for k in range(min_words):
                if k:
                    words = words + F.get(lines, j + step * k)["n"]
                value = F.shiftleft((j if step > 0 else j - k).cast("long"), bits) + k
                end = F.when(words >= min_words, value) if end is None else end.when(words >= min_words, value)
            return end

        return at

    every = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: j < F.size(lines))  # without lines, sequence(0, -1) counts down
    every = F.when(F.size(lines) > 0, every).otherwise(F.array().cast("array<int>"))
    # Longs, as Spark compares arrays of structs pair by pair.
    found = F.array_distinct(F.filter(F.concat(F.transform(every, ends(1)), F.transform(every, ends(-1))), lambda x: x.isNotNull()))

    def select(w: Column) -> Column:
        left, more = F.shiftright(w, bits).cast("int"), w.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        least = let(F.transform(F.slice(lines, left + 1, more + 1), lambda x: x["h"]), lambda h: F.array_position(h, F.array_min(h)).cast("int") - 1)
        return let(F.when(more == 0, F.lit(0)).otherwise(least), lambda before: F.shiftleft((left + before).cast("long"), 2 * bits) + F.shiftleft(before, bits) + more)

    return F.transform(found, select)


def _windows_around(places: Column, min_words: int) -> Column:
    """What _windows() may give for windows with these places."""
    bits = _bits(min_words)
    shapes = [(before << bits) + more for more in range(min_words) for before in range(more + 1)]
    return F.flatten(F.transform(places, lambda p: F.transform(F.array(*map(F.lit, shapes)), lambda x: F.shiftleft(p.cast("long"), 2 * bits) + x)))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4) -> DataFrame:
    """(id, text_hash, lines): for each document that has any, the positions of its lines that repeat an earlier run. Time and space grow with the number of lines, in one text too."""
    text, bits = text_or_empty(text_col), _bits(min_words)
    line = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0)
    base = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), line.alias("lines")).withColumn("windows", _windows(F.col("lines"), min_words)), "line-hashes")
    doc = F.struct("id", "text_hash")
    # Every selected position once, whatever the number of windows that selected it.
    chosen = F.array_distinct(F.transform("windows", lambda w: F.shiftright(w, 2 * bits).cast("int")))
    # What is exploded brings its lines along, so that no row carries the whole array of them.
    places = base.select("id", "text_hash", F.explode(F.transform(chosen, lambda p: F.struct(p.alias("place"), F.get("lines", p)["h"].alias("h")))).alias("p")).select("id", "text_hash", "p.*")
    met = places.groupBy("h").agg(F.min(F.struct(doc, "place")).alias("a"), F.max(F.struct(doc, "place")).alias("b")).filter("a < b").select("h")
    joined = places.join(written(met, "line-fingerprints"), "h", "left_semi").groupBy("id", "text_hash").agg(F.collect_set("place").alias("places"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))
    low = F.lit((1 << bits) - 1)

    def part(w: Column) -> Column:
        before, more = F.shiftright(w, bits).bitwiseAND(low).cast("int"), w.bitwiseAND(low).cast("int")
        return F.struct(before.alias("before"), F.slice("lines", F.shiftright(w, 2 * bits).cast("int") - before + 1, more + 1).alias("part"))

    wanted = F.transform(F.array_intersect("windows", _windows_around(F.col("places"), min_words)), part)
    around = base.join(joined.withColumnsRenamed({"id": "of", "text_hash": "hash"}), same).select("id", "text_hash", F.explode(wanted).alias("w")).select("id", "text_hash", "w.*")
    matches = around.select("id", "text_hash", F.col("part.i").alias("at"), F.xxhash64("part.h").alias("ahead"), F.xxhash64("part.g").alias("around"), "before")
    matches = written(matches, "line-matches")
    place = F.struct("id", "text_hash", F.col("at")[0].alias("line"))
    key = ["ahead", "around", "before"]
    first = written(matches.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last"), "line-first")
    later = matches.join(first, key).filter(place > F.col("first"))
    return later.groupBy("id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4) -> DataFrame:
    """The rows of docs with n_lines, deleted (positions from 0) and clean (the text without those lines).

    A line goes when it lies in a run of consecutive non-blank lines, of min_words words or more together, that also
    stands earlier: in a document with a smaller id (null first; among equal ids by a hash of the text) or further up
    in the same one. Runs of fewer words and blank lines stay. Rows equal in id and text count as one document. Null
    texts have one empty line and an empty clean text; no rows give no rows. Very long texts are read whole, in time
    that grows with their lines: a row holds its text's lines and their hashes. Other columns are kept as they are, whatever their names, but for n_lines,
    deleted and clean, which are replaced.
    """
    of, hashed, gone = spare(docs, "id_of", "hash_of", "gone")
    lost = repeated_lines(docs, id_col, text_col, min_words).select(F.col("id").alias(of), F.col("text_hash").alias(hashed), F.col("lines").alias(gone))
    text = text_or_empty(text_col)
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(hashed)), "left")
    lines = _lines(text)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    out = [docs[c] for c in docs.columns if c not in ("n_lines", "deleted", "clean")]
    return joined.select(*out, F.size(lines).alias("n_lines"), F.coalesce(F.col(gone), F.array().cast("array<int>")).alias("deleted"), F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n")).alias("clean"))
