"""Operator 11: spelling variants of frequent words, by Bloom-guided neighbourhoods.

Words of the corpus are counted with partial sums. Every edit of a word (a letter left out, or replaced by a later one) is probed against blocked Bloom
filters of the vocabulary, one for each length, that are broadcast within a fixed size. Only positives are shuffled, as pairs of 64-bit
numbers, and joined with the vocabulary, which removes the false ones; the edit itself is then made again in columns and compared.

Edits are never spelled out before that: a word's number is the sum of a random number for each (place, letter), so the number of an edit is a
difference from the word's own, taken for all places of many words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialise
from pagewright.llm.repeated_lines import LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
#: Of one occurrence in so many a letter is taken out, by a checksum of document and word.
NOISE = 97
#: Lengths from here on share a filter.
LONGEST = 64
#: A block is eight 64-bit words, in each of which a word of the vocabulary sets one bit.
BLOCK_BITS, WORDS = 512, 8
BITS_PER_WORD = 12
#: All filters together take no more (32 MB), however large the vocabulary: beyond some 20 million words they get denser and let more pass.
MAX_BITS = 1 << 28
#: Places x words that are probed at once.
CHUNK = 1 << 19


def occurrences(docs: DataFrame, min_chars: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): a row for each run of letters of the texts, A-Z in lower case, a letter taken out of some, if it is long enough then."""
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.filter(F.char_length("_run") >= min_chars)
    plain = F.octet_length("_run") == F.char_length("_run")  # letters of ASCII alone
    runs = runs.withColumn("_low", F.when(plain, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)))
    checksum = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_low").cast("binary"))
    at = (checksum % F.char_length("_low")).cast("int")
    less = F.concat(F.substring("_low", F.lit(1), at), F.substring(F.col("_low"), at + 2, F.char_length("_low")))
    return runs.select(F.when(checksum % NOISE == 0, less).otherwise(F.col("_low")).alias("word")).filter(F.char_length("word") >= min_chars)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return _mixed(((places.astype(np.uint64) << np.uint64(21)) | letters.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as code points, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_numbers(words: list[str]) -> np.ndarray:
    """The sum of each word's terms; words may differ in length."""
    out = np.zeros(len(words), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        if n:
            step = max(1, CHUNK // n)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                out[part] = _terms(np.arange(n)[None, :], _letters([words[i] for i in part])).sum(axis=1, dtype=np.uint64)
    return out


def _bits(numbers: np.ndarray, k: int) -> np.ndarray:
    """The bit that a number sets in the k-th word of its block."""
    return np.uint64(1) << ((_mixed(numbers + np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(6 * k)) & np.uint64(63))


def _blocks(numbers: np.ndarray, n: int) -> np.ndarray:
    return ((_mixed(numbers) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, number): the distinct words found often enough."""
    counted = occurrences(docs, min_chars, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = word_numbers(batch.column("word").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(numbers)], ["word", "n", "number"])

    return counted.mapInArrow(number, "word string, n long, number long")


def shard_of(length: Column) -> Column:
    return F.least(length, F.lit(LONGEST))


def filters_of(words: DataFrame, max_bits: int = MAX_BITS) -> dict[int, np.ndarray]:
    """Shard of length -> its blocks (n, 8). At most `max_bits` in all, and a block for each shard; built in tasks and put together by block."""
    counts = {r.shard: r.n for r in words.groupBy(shard_of(F.char_length("word")).alias("shard")).agg(F.count("*").alias("n")).collect()}
    density = min(BITS_PER_WORD, max_bits / max(1, sum(counts.values())))
    sizes = {shard: max(1, int(n * density) // BLOCK_BITS) for shard, n in counts.items()}
    names = [f"w{k}" for k in range(WORDS)]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("number").to_numpy().view(np.uint64)
            shards = batch.column("shard").to_numpy()
            blocks = _blocks(numbers, 1)
            for shard in np.unique(shards):
                at = shards == shard
                blocks[at] = _blocks(numbers[at], sizes[int(shard)])
            columns = [pa.array(shards), pa.array(blocks.astype(np.int32)), *(pa.array(_bits(numbers, k).view(np.int64)) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "block", *names])

    bits = words.select("number", shard_of(F.char_length("word")).alias("shard")).mapInArrow(own, "shard int, block int, " + ", ".join(f"{c} long" for c in names))
    found = bits.groupBy("shard", "block").agg(*[F.bit_or(c).alias(c) for c in names]).toArrow()
    out = {shard: np.zeros((n, WORDS), np.uint64) for shard, n in sizes.items()}
    shards, blocks = found.column("shard").to_numpy(), found.column("block").to_numpy()
    values = np.stack([found.column(c).to_numpy() for c in names], axis=1).view(np.uint64) if len(found) else np.zeros((0, WORDS), np.uint64)
    for shard in out:
        at = shards == shard
        out[shard][blocks[at]] = values[at]
    return out


def _held(filters: dict[int, np.ndarray], length: int, numbers: np.ndarray) -> np.ndarray:
    """The places of the numbers that the filter of a length may hold."""
    shard = filters.get(min(length, LONGEST))
    if shard is None:
        return np.zeros(0, np.int64)
    blocks, at = _blocks(numbers, len(shard)).astype(np.int64), np.arange(len(numbers))
    for k in range(WORDS):
        ok = shard[blocks, k] & _bits(numbers, k) != 0
        blocks, numbers, at = blocks[ok], numbers[ok], at[ok]
    return at


def _positives(words: list[str], alphabet: list[int], filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of words of one length (index of the word, place, letter put there or 0 for none, number of the edit) that a filter may hold.

    Each pair of near words is met once: from the longer one, by leaving out the last of equal neighbours, or from the one with the smaller letter.
    """
    letters = _letters(words)
    m, n = letters.shape
    places = np.arange(n)
    terms = _terms(places[None, :], letters)
    whole = terms.sum(axis=1, dtype=np.uint64)
    moved = _terms(np.maximum(places - 1, 0)[None, :], letters)  # the letters one place further left
    after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
    left_out = np.cumsum(terms, axis=1, dtype=np.uint64) - terms + after
    row, place = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((m, 1), bool)], axis=1))
    numbers = left_out[row, place]
    at = _held(filters, n - 1, numbers)
    yield row[at], place[at], np.zeros(len(at), np.int64), numbers[at]
    rest = whole[:, None] - terms
    for letter in alphabet:
        row, place = np.nonzero(letters < letter)
        numbers = rest[row, place] + _terms(places, np.full(n, letter))[place]
        at = _held(filters, n, numbers)
        yield row[at], place[at], np.full(len(at), letter), numbers[at]


def near_words(words: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of near words of a written vocabulary (word, n, number), each once."""
    spark = words.sparkSession
    alphabet = sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect())  # 116 letters at most
    filters = spark.sparkContext.broadcast(filters_of(words, max_bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled, own = batch.column("word").to_pylist(), batch.column("number").to_numpy()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(spelled):
                by_length.setdefault(len(w), []).append(i)
            for n, at in by_length.items():
                step = max(1, CHUNK // n)
                for k in range(0, len(at), step):
                    part = np.array(at[k : k + step])
                    for row, place, letter, numbers in _positives([spelled[i] for i in part], alphabet, filters.value):
                        if len(row):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(own[part[row]]), pa.array(place.astype(np.int32)), pa.array(letter.astype(np.int32)), pa.array(numbers.view(np.int64))], ["own", "place", "letter", "edit"]
                            )

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    positives = words.select("word", "number").repartition(tasks, "number").mapInArrow(probe, "own long, place int, letter int, edit long")
    pairs = positives.join(words.select(F.col("number").alias("edit"), F.col("word").alias("b"), F.col("n").alias("b_n")), "edit")
    pairs = pairs.join(words.select(F.col("number").alias("own"), F.col("word").alias("a"), F.col("n").alias("a_n")), "own")
    put = F.when(F.col("letter") > 0, F.char("letter")).otherwise("")  # all letters are below 256
    edited = F.concat(F.substring(F.col("a"), F.lit(1), F.col("place")), put, F.substring(F.col("a"), F.col("place") + 2, F.char_length("a")))
    return pairs.filter(edited == F.col("b")).select("a", "a_n", "b", "b_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of each word's forms. A form is at least twice as frequent, so there are no circles, and as each round
    doubles the way gone, a handful of rounds do."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = materialise(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not then.filter("_moved").isEmpty()
        now = then.select("word", "root")
        if not moved:
            return now


def spelling_forms(docs: DataFrame, min_chars: int = 5, min_count: int = 3, factor: int = 2, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the vocabulary.

    Words are the runs of letters (RUN) of all texts, A-Z in lower case; of one occurrence in 97, by the CRC-32 of `<doc_id>:<run>`, the letter
    at checksum % length is taken out. Those of at least `min_chars` code points found at least `min_count` times count. Two are
    near if one letter put in, left out or replaced makes one the other. A word's form is its near word of the largest n, the first in code-point order of several,
    if that n is at least `factor` times its own, else null; the root is where forms lead to, the word itself without one.

    Null and empty texts have no words; an id may be null (it is written as empty) or repeated; rows count as often as they occur. Other columns are
    ignored. No words in, no rows out. The filters are broadcast within `max_bits`; the vocabulary, near pairs and forms stay distributed.
    """
    words = materialise(vocabulary(docs, min_chars, min_count, id_col, text_col))
    pairs = materialise(near_words(words, max_bits))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy("a").agg(F.count("*").alias("n_near"), F.max("a_n").alias("_n"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("_best"))
    near = near.withColumn("form_n", -F.col("_best.less")).withColumn("_takes", F.col("form_n") >= factor * F.col("_n"))
    near = materialise(near.select(F.col("a").alias("word"), "n_near", F.when(F.col("_takes"), F.col("_best.form")).alias("form"), F.when(F.col("_takes"), F.col("form_n")).alias("form_n")))
    roots = roots_of(near.filter("form is not null"))
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
