"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import cut_lineage, gapless_rank, word_count

LENGTHS = (512, 1024, 2048, 4096)


def best_fit(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = 16) -> tuple[list[tuple], list[tuple]]:
    """Pack items, given only as how many there are of each size, by best-fit decreasing with several bin lengths.

    Sizes go from large to small. An item goes to the open bin with the least room that holds it. If none does, a bin
    opens whose length costs least for each token it can hold of that size: (length + overhead) / (size * how many fit);
    overhead is the fixed cost of a sequence; ties go to the longer length. In the end each bin shrinks to the shortest length that
    holds its contents. Bins with equal contents are handled as one run of bins, so the work grows with the number of
    sizes (at most the largest length), not with documents.

    Returns placements (size, first rank, bins, items a bin, first bin, offset, contents, length): the item of rank r
    among those of its size lies in bin `first bin + (r - first rank) // items a bin`, which has such contents and length
    in the end; and runs (first bin, bins, contents, length).
    """
    placed: list[tuple] = []
    runs: dict[int, list[tuple]] = {}  # room -> [(first bin, bins, filled)]
    rooms: list[int] = []  # sorted
    done: list[tuple] = []
    bins = 0

    def put(first: int, n: int, filled: int, room: int) -> None:
        if room == 0:
            done.append((first, n, filled))
        else:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, n, filled))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fits = [(n, n // size) for n in lengths if n >= size]
                length, each = min(fits, key=lambda x: ((x[0] + overhead) / (size * x[1]), -x[0]))
                need = -(-left // each)
                put(bins, need, 0, length)
                bins += need
                continue
            room = rooms[at]
            first, n, filled = runs[room].pop()
            each = room // size
            if left < each:
                use, each = 1, left
            else:
                use = min(n, left // each)
            if use < n:
                runs[room].append((first + use, n - use, filled))
            elif not runs[room]:
                del runs[room], rooms[at]
            placed.append((size, rank, use, each, first, filled))
            rank, left = rank + use * each, left - use * each
            put(first, use, filled + each * size, room - each * size)
    done += [x for group in runs.values() for x in group]
    ended = sorted((first, n, filled, next(x for x in lengths if x >= filled)) for first, n, filled in done if filled)
    starts, split = [x[0] for x in ended], []
    for size, rank, n, each, first, offset in placed:  # a placement's bins may have ended with different contents
        i = bisect_right(starts, first) - 1
        while i < len(ended) and ended[i][0] < first + n:
            a, z = max(first, ended[i][0]), min(first + n, ended[i][0] + ended[i][1])
            split.append((size, rank + (a - first) * each, z - a, each, a, offset, *ended[i][2:]))
            i += 1
    return split, ended


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Pack all documents into sequences of the permitted `lengths`.

    A document has its words and one end token. One longer than the largest length is cut into pieces of that length and
    a rest; nothing is dropped. The driver packs the histogram of piece sizes (at most max(lengths) rows) by `best_fit`;
    documents then find their bins by their rank among pieces of equal size, which `gapless_rank` gives without putting a
    size into one task. The packing is the same for any partitioning.

    Defined cases: a null or empty text is its end token alone; repeated rows are packed as often as they occur; an empty
    table gives no rows; other columns are ignored.
    Returns doc_id, piece, first_token, n_tokens, bin, bin_offset, bin_tokens, bin_length: one row a piece.
    """
    spark, largest = docs.sparkSession, max(lengths)
    sized = docs.select("doc_id", (word_count(F.col("text")) + 1).alias("_n"))
    pieces = cut_lineage(sized.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {largest} as int)"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("first_token"), F.least(F.lit(largest), F.col("_n") - F.col("piece") * largest).cast("int").alias("n_tokens")))
    counts = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, _ = best_fit(counts, tuple(sorted(lengths)))
    # Bounded by the lengths, not by the documents: a size splits each run of like bins at most once.
    where = F.broadcast(spark.createDataFrame(placed, "n_tokens int, _rank long, _bins long, _each long, _bin long, _offset long, bin_tokens long, bin_length long"))
    ranked = gapless_rank(pieces, ["n_tokens"], ["doc_id", "piece"], "_r")
    inside = (F.col("r.n_tokens") == F.col("w.n_tokens")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_bins") * F.col("_each"))
    return ranked.alias("r").join(where.alias("w"), inside).select(
        "doc_id", "piece", "first_token", "r.n_tokens", F.expr("_bin + (_r - _rank) div _each").alias("bin"),
        (F.col("_offset") + F.expr("(_r - _rank) % _each") * F.col("r.n_tokens")).alias("bin_offset"), "bin_tokens", "bin_length")
