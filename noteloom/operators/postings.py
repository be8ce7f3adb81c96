"""An inverted file for keyword search, written once and read by key.

Chunks are dealt into blocks by a hash of their id. A row lists, for a trigram and a block, which
chunks of the block hold it and how often: ``block, gram, places, tf``. Every block also has a row
of the empty trigram with the ids, lengths and bases of its chunks, in order of their places.
Files lie in folders by a hash of the trigram, so a search opens only the folders of its own trigrams, and are bucketed by block,
so a trigram that occurs everywhere is spread over all blocks and a block is scored where it is
read, without an exchange. ``grams`` has the number of chunks that hold each trigram.

Two kinds of trigrams can be indexed: windows of the lower-cased text (``text``), where the length
of a chunk counts all windows, and trigrams of padded words (``words``), where it counts the
distinct ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import settings as S
from noteloom.functions import grams as G
from noteloom.functions.binding import let
from noteloom.functions.topk import RunningTopK
from noteloom.operators.scoring import merge_top
from noteloom.session import checkpoint_root, checkpointed, hinted

#: Scores are summed as whole numbers of this part of one, so that equal texts tie exactly.
SCALE = 10**9
GRAM_FOLDERS = 16
BLOCK_CHUNKS = 16384
#: A bucket of fewer chunks is not worth its files.
MIN_BUCKET_CHUNKS = 2048
#: A task writes or reads about so many blocks at most, so that it sorts their rows in memory.
BUCKET_BLOCKS = 2
#: Questions of one pass over the index, so that their sums over a block stay a small matrix.
PASS_QUESTIONS = 256
_SLICE = 512
#: A list that holds more than this part of its block is added as a whole row.
_DENSE = 8
_COLUMNS = ("block", "gram", "places", "tf", "chunk_ids", "lengths", "kb_ids")
_ROWS = "block int, gram string, places array<int>, tf array<int>, chunk_ids array<bigint>, lengths array<int>, kb_ids array<string>"
_HITS = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Postings:
    """Where an index lies, how it is laid out, and its totals."""

    spark: SparkSession
    table: str
    path: str
    kind: str
    folders: int
    chunks: int
    tokens: int
    head_folder: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def rows(self) -> DataFrame:
        """A row for each trigram and chunk: chunk_id, gram, tf."""
        ids = self.blocks.filter(F.col("gram") == "").select("block", F.posexplode("chunk_ids").alias("place", "chunk_id"))
        each = F.explode(F.arrays_zip("places", "tf")).alias("p")
        lists = self.blocks.filter(F.col("gram") != "").select("block", "gram", each).select(
            "block", "gram", F.col("p.places").alias("place"), F.col("p.tf").alias("tf"))
        return lists.join(ids, ["block", "place"]).select("chunk_id", "gram", "tf")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    @property
    def mean_length(self) -> float:
        return self.tokens / self.chunks if self.chunks else 0.0


def folder_of(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


# --- building ----------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def _windows(texts: list[str], whole_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for the three code points and the text of every window, and the code points in use.

    The number is ``((a * n + b) * n + c) * m + text`` with places a, b, c among the n code points in use
    and m texts. Windows over a NUL do not count if ``whole_words``.
    """
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    used = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    used[points] = True
    alphabet = np.flatnonzero(used)
    n, m = max(len(alphabet), 1), len(texts)  # a block is small, so a trigram and a text fit one number
    code = (np.cumsum(used, dtype=np.int32) - 1)[points]
    text = np.repeat(np.arange(m, dtype=np.int32), np.fromiter((len(t) + 1 for t in texts), np.int64, m))[:len(code)]
    last = max(len(code) - 2, 0)
    inside = text[:last] == text[2:]
    at = np.cumsum(np.bincount(text, minlength=m))[:-1] - 1  # the NUL after each text but the last
    for k in range(3):
        inside[(at - k)[(at >= k) & (at - k < last)]] = False
    if whole_words:
        blank = points == 0
        inside &= ~(blank[:last] | blank[1:last + 1] | blank[2:])
    number = code[:last].astype(np.int64)
    for k in (1, 2):
        number *= n
        number += code[k:last + k]
    number *= m
    number += text[:last]
    return number[inside], alphabet


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts in an ordered column, and how long it is."""
    n = len(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if n else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, n))


def _index_block(kind: str, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """The index rows of the chunks of one block."""
    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        texts, ids = table["text"].to_pylist(), table["chunk_id"].to_numpy()
        if kind == "words":  # blanks around each word; windows over the NUL between words do not count
            texts = ["\0".join(f"  {w} " for w in dict.fromkeys(_WORD.findall(t))) for t in texts]
        pair, alphabet = _windows(texts, kind == "words")
        n, m = max(len(alphabet), 1), len(ids)
        pair.sort()
        first, tf = _runs(pair)
        gram, row = pair[first] // m, pair[first] % m
        start, _ = _runs(gram)
        names = gram[start]
        letters = (alphabet[names // n**2], alphabet[names // n % n], alphabet[names % n])
        grams = [chr(a) + chr(b) + chr(c) for a, b, c in zip(*(x.tolist() for x in letters), strict=True)]
        lengths = np.bincount(row, minlength=m).tolist() if kind == "words" else [max(0, len(t) - 2) for t in texts]
        offsets = pa.array(np.concatenate([[0, 0], np.append(start, len(gram))[1:]]), pa.int32())
        rows = len(grams) + 1

        def once(values: list, of: pa.DataType) -> pa.Array:
            return pa.array([values, *[None] * (rows - 1)], pa.list_(of))

        columns = [
            pa.array(np.full(rows, table["block"][0].as_py()), pa.int32()), pa.array(["", *grams], pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(row, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
            once(ids.tolist(), pa.int64()), once(lengths, pa.int32()), once(table["kb_id"].to_pylist(), pa.string())]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    return index


def _lowered(chunks: DataFrame) -> DataFrame:
    scope = F.col("kb_id") if "kb_id" in chunks.columns else F.lit(None)
    return chunks.select("chunk_id", scope.cast("string").alias("kb_id"), F.lower(F.coalesce("content", F.lit(""))).alias("text"))


def gram_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks per trigram of a chunk table without an index, by expressions alone: (gram, df, tokens)."""
    each = F.explode(F.array_append(F.array_distinct(G.sliding_grams(F.col("text"))), F.lit(""))).alias("gram")
    rows = _lowered(chunks.select("chunk_id", "content")).select(F.greatest(F.length("text") - 2, F.lit(0)).alias("length"), each)
    return rows.groupBy("gram").agg(F.count("*").alias("df"), F.sum("length").alias("tokens"))


def build_postings(
    chunks: DataFrame, kind: str = "text", *, path: str | None = None, folders: int = GRAM_FOLDERS, buckets: int | None = None,
    block_chunks: int = BLOCK_CHUNKS,
) -> Postings:
    """Write the index of ``chunks`` (chunk_id, content, and kb_id if there are several bases).

    ``buckets`` is the number of scan tasks, by default that of shuffle partitions, or fewer for a
    small table and more for one whose buckets would hold many blocks; blocks hold about ``block_chunks`` chunks. The statistics are counted from the written postings.
    """
    if kind not in ("text", "words"):
        raise ValueError("kind must be 'text' or 'words'")
    spark = chunks.sparkSession
    path = path or f"{checkpoint_root(spark)}/postings-{uuid.uuid4().hex}"
    n = chunks.count()
    fewest = -(-n // (BUCKET_BLOCKS * block_chunks))
    buckets = buckets or max(1, fewest, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // MIN_BUCKET_CHUNKS)))
    blocks = max(buckets, -(-n // block_chunks))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
    schema = pa.schema([
        ("block", pa.int32()), ("gram", pa.string()), ("places", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())),
        ("chunk_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("kb_ids", pa.list_(pa.string()))])
    rows = _lowered(chunks).withColumn("block", block).repartition(buckets, "block").groupBy("block").applyInArrow(_index_block(kind, schema), _ROWS)
    table = f"postings_{uuid.uuid4().hex}"
    rows.withColumn("folder", folder_of(F.col("gram"), folders)).write.partitionBy("folder").bucketBy(buckets, "block").sortBy(
        "block", "gram").option("path", f"{path}/rows").saveAsTable(table)
    tokens = F.aggregate(F.coalesce("lengths", F.array()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    counted = spark.table(table).groupBy("gram").agg(F.sum(F.when(F.col("gram") == "", F.size("chunk_ids")).otherwise(F.size("places"))).alias("df"), F.sum(tokens).alias("tokens"))
    counted.write.parquet(f"{path}/grams")
    spark.createDataFrame([(kind, folders, buckets)], "kind string, folders int, buckets int").coalesce(1).write.parquet(f"{path}/layout")
    return _opened(spark, table, path, kind, folders)


def _opened(spark: SparkSession, table: str, path: str, kind: str, folders: int) -> Postings:
    head = spark.range(1).select(folder_of(F.lit(""), folders).alias("folder"))
    totals = spark.read.parquet(f"{path}/grams").filter(F.col("gram") == "").select("df", "tokens")
    total = head.join(totals, F.lit(True), "left").first()
    return Postings(spark, table, path, kind, folders, total["df"] or 0, total["tokens"] or 0, total["folder"])


def open_postings(spark: SparkSession, path: str) -> Postings:
    """An index that an earlier session wrote to ``path``."""
    layout = spark.read.parquet(f"{path}/layout").first()
    table = f"postings_{uuid.uuid4().hex}"
    columns = _ROWS.replace(", ", ",\n  ")
    spark.sql(
        f"CREATE TABLE {table} ({columns}, folder int) USING parquet PARTITIONED BY (folder) "
        f"CLUSTERED BY (block) SORTED BY (block, gram) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return _opened(spark, table, path, layout["kind"], layout["folders"])


# --- searching ---------------------------------------------------------------------------------


def folded_grams(text: Column) -> Column:
    """The distinct trigrams of a question, in lower case, with how often each was asked: array of (gram, times).

    Text is lower-cased before it is cut, as chunks are. Trigrams that differ only in case are
    asked once each and count as often; where lower case changes the length they cannot be told
    apart and count once.
    """
    same_length = F.length(F.lower(text)) == F.length(text)
    asked = F.when(same_length, F.transform(G.query_grams(text), F.lower)).otherwise(G.query_grams(F.lower(text)))
    return let(asked, lambda grams: F.transform(
        F.array_distinct(grams),
        lambda g: F.struct(g.alias("gram"), F.size(F.filter(grams, lambda x: x == g)).cast("bigint").alias("times"))))


@dataclass(frozen=True)
class _Asked:
    """The questions of one pass: their trigrams with who asks them, their bases and sizes."""

    ids: np.ndarray
    kb_ids: list[str | None]
    grams: dict[str, int]
    worth: np.ndarray  # of each trigram
    askers: list[tuple[np.ndarray, np.ndarray]]  # of each trigram: the questions and how often they ask it
    sizes: np.ndarray  # of each question: its trigrams with their times

    def scope(self, kb_ids: list[str | None]) -> np.ndarray:
        """[chunk, question]: the question covers all bases or the chunk's."""
        inside = np.ones((len(kb_ids), len(self.ids)), dtype=bool)
        have = np.array(kb_ids, dtype=object)
        for q, wanted in enumerate(self.kb_ids):
            if wanted is not None:
                inside[:, q] = have == wanted
        return inside


#: Values of a trigram in chunks of some lengths (tf, lengths, worth), and scores from their sums (sums, lengths).
Values = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Scores = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _score_block(asked: _Asked, top_n: int, values: Values, scores: Scores) -> Callable[[pa.Table], pa.Table]:
    def score(table: pa.Table) -> pa.Table:
        grams = table["gram"].to_pylist()
        head = grams.index("")
        ids = table["chunk_ids"][head].values.to_numpy()
        lengths = table["lengths"][head].values.to_numpy()
        kb_ids = table["kb_ids"][head].as_py()
        lists = table["places"].combine_chunks()
        column = np.array([asked.grams.get(g, 0) for g in grams])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        place, tf = lists.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy()
        value = values(tf, lengths[place], np.repeat(np.append(asked.worth, 0.0)[column], np.diff(offsets)))

        def summed(of: np.ndarray) -> np.ndarray:
            """[question, chunk]: whole numbers, so the order of the lists is of no matter."""
            sums = np.zeros((len(asked.ids), len(ids)))
            for gram, start, stop in zip(column.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if start == stop:
                    continue
                who, times = asked.askers[gram]
                at, worth = place[start:stop], of[start:stop]  # a chunk is once in a list
                if len(who) > 1 and _DENSE * len(at) > len(ids):
                    row = np.zeros(len(ids))
                    row[at] = worth
                    for q, n in zip(who.tolist(), times.tolist(), strict=True):
                        sums[q] += row if n == 1 else n * row
                else:
                    for q, n in zip(who.tolist(), times.tolist(), strict=True):
                        sums[q, at] += worth if n == 1 else n * worth
            return sums

        sums = summed(value)
        # A match can be worth nothing after rounding and is still a match.
        matched = sums > 0 if value.all() else summed(np.ones(len(value))) > 0
        best = RunningTopK(len(asked.ids), top_n)
        for start in range(0, len(ids), _SLICE):
            part = slice(start, start + _SLICE)
            result, accepted = scores(sums[:, part].T, lengths[part])
            best.update(result, ids[part], matched[:, part].T & accepted & asked.scope(kb_ids[part]))
        q, found, result = best.rows()
        return pa.Table.from_arrays(
            [pa.array(asked.ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(result, pa.float64())], schema=_HITS)

    return score


def _passes(
    questions: DataFrame, postings: Postings, each: Column, worth: Callable[[DataFrame], DataFrame], top_n: int,
    values: Values, scores: Callable[[_Asked], Scores],
) -> DataFrame:
    """The best chunks of each question, a bounded number of questions at a time."""
    n = questions.count()
    slices = max(1, -(-n // PASS_QUESTIONS))
    scope = F.col("kb_id").cast("string") if "kb_id" in questions.columns else F.lit(None).cast("string")
    asked = questions.select("question_id", scope.alias("kb_id"), "text")
    if slices > 1:  # the numbering decides only which questions share a pass
        asked = checkpointed(asked.withColumn("slice", F.pmod(F.xxhash64("question_id"), F.lit(slices))))
    found = []
    for i in range(slices):
        part = asked.filter(F.col("slice") == i) if slices > 1 else asked
        terms = part.select("question_id", "kb_id", F.explode(each).alias("t")).select("question_id", "kb_id", "t.gram", "t.times")
        folder = folder_of(F.col("gram"), postings.folders).alias("folder")
        weighted = worth(terms).select("question_id", "kb_id", "gram", "times", "worth", folder).toPandas()
        grams = {g: k for k, g in enumerate(sorted(set(weighted["gram"])))}
        of = weighted.drop_duplicates("question_id").set_index("question_id")["kb_id"]
        place = {q: k for k, q in enumerate(of.index)}
        value, sizes = np.zeros(len(grams)), np.zeros(len(place))
        columns = weighted["gram"].map(grams).to_numpy(dtype=np.int64)
        rows_of = weighted["question_id"].map(place).to_numpy(dtype=np.int64)
        value[columns] = weighted["worth"]
        times = weighted["times"].to_numpy(dtype=np.float64)
        np.add.at(sizes, rows_of, times)
        order = np.argsort(columns, kind="stable")
        ends = np.searchsorted(columns[order], np.arange(1, len(grams)))
        askers = list(zip(np.split(rows_of[order], ends), np.split(times[order], ends), strict=True))
        batch = _Asked(of.index.to_numpy(), of.astype(object).where(of.notna(), None).tolist(), grams, value, askers, sizes)
        # A pass has a bounded number of questions, so its folders and trigrams are few.
        used = F.col("folder").isin(sorted({postings.head_folder, *map(int, weighted["folder"])}))
        names = postings.spark.createDataFrame([(g,) for g in ("", *grams)], "gram string")
        rows = postings.blocks.filter(used).join(F.broadcast(names), "gram", "left_semi")
        kernel = _score_block(batch, top_n, values, scores(batch))
        found.append(rows.select(*_COLUMNS).groupBy("block").applyInArrow(
            kernel, "question_id bigint, chunk_id bigint, score double"))
    return merge_top(reduce(DataFrame.unionByName, found), top_n, "keyword_rank")


def bm25_hits(questions: DataFrame, postings: Postings, top_n: int = S.KEYWORD_TOP_N) -> DataFrame:
    """The best chunks of each question by BM25 over its trigrams: question_id, chunk_id, score, keyword_rank.

    Statistics are those of the whole index, whatever the scope of a question.
    """
    if postings.kind != "text":
        raise ValueError("BM25 needs an index of kind 'text'")
    df, n = F.col("df").cast("double"), float(postings.chunks)
    raw = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(raw <= 0, F.lit(S.BM25_IDF_FLOOR)).otherwise(raw)
    k1, b, mean = S.BM25_K1, S.BM25_B, postings.mean_length or 1.0

    def values(tf: np.ndarray, lengths: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return np.rint(idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / mean))) * SCALE)

    return _passes(
        questions, postings, folded_grams(F.col("text")), lambda terms: postings.grams.join(hinted(terms), "gram").withColumn("worth", idf),
        top_n, values, lambda _: lambda sums, lengths: (sums / SCALE, np.ones(sums.shape, dtype=bool)))


def word_hits(
    questions: DataFrame, postings: Postings, top_n: int = S.KEYWORD_TOP_N, min_similarity: float = S.TRGM_MIN_SIMILARITY,
) -> DataFrame:
    """The best chunks of each question by shared word trigrams: question_id, chunk_id, score, keyword_rank."""
    if postings.kind != "words":
        raise ValueError("word trigram search needs an index of kind 'words'")
    each = F.transform(G.word_grams(F.col("text")), lambda g: F.struct(g.alias("gram"), F.lit(1).cast("bigint").alias("times")))

    def scores(asked: _Asked) -> Scores:
        sizes = asked.sizes

        def similarity(shared: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            union = lengths[:, None] + sizes[None, :] - shared
            result = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
            return result, result >= min_similarity

        return similarity

    return _passes(
        questions, postings, each, lambda terms: terms.withColumn("worth", F.lit(1.0)), top_n,
        lambda tf, lengths, worth: np.ones(len(tf)), scores)
