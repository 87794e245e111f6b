"""Language-model scoring by the marginal likelihood of a subword lattice.

A word is spelled by the pieces of an existing subword vocabulary in every possible way;
its probability is the sum over all of them of the product of the pieces' probabilities,
by a forward recursion in log space. A text is the product of its words and one end.
The pieces' probabilities start from the vocabulary's own scores, as a rank law, and are
re-weighted by how often the training texts use each piece, counted per distinct word
with every segmentation weighted by its probability. One more path leads through a whole
word of the training texts, with its relative frequency: in N tokens of T kinds, a share
of T / (N + T) is left to the pieces. The probabilities of all words and the end add up
to one.

Words are separated by ASCII white space, A-Z is lower-cased. Every distinct word is
counted and scored once for the whole corpus, in sorted order inside a task, so that words
share the work on their common beginnings. Frequent words, a bounded number, are sent to
all tasks; the others are joined by the word. Null text counts as empty: one end.
Null ids belong to the training rows; repeated rows stay and count each time; other columns
are ignored, whatever their names. An empty table gives no rows. Texts are read in blocks of
whole words, so a text's length is not limited; words of equal counts are alike for the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import as_bytes, blocks, lower_ascii, map_batches, map_partitions
from placelab.session import discard, materialize

START = "▁"
FREQUENT, FREQUENT_BYTES, COUNTER_ENTRIES = 100_000, 64, 300_000
END = "</s>"
SMALLEST = -745.0


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with their weight 1 / (1 - score): scores fall by one with the rank.

    Bytes are pieces like ``<0x41>``; control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i)] = 1.0 / (1.0 - min(model.get_score(i), 0.0)) if not model.is_byte(i) else 1e-6
    return pieces


class Lattice:
    """Log probabilities of words under piece log probabilities."""

    def __init__(self, logs: dict[str, float]) -> None:
        self.logs = {p: v for p, v in logs.items() if not (p.startswith("<0x") and len(p) == 6)}
        self.bytes = [logs.get(f"<0x{b:02X}>", SMALLEST) for b in range(256)]
        prefixes = {p[:n] for p in self.logs for n in range(1, len(p))}
        #: of every piece and every start of one: its log weight, if it is a piece, and whether longer pieces begin with it
        self.parts = {p: (self.logs.get(p), p in prefixes) for p in prefixes | self.logs.keys()}

    def log_probability(self, word: str) -> float:
        return Walk(self).forward(word)

    def add_expected(self, word: str, weight: float, counts: dict[str, float]) -> None:
        """Add how often each piece is used, over all segmentations, times ``weight``."""
        walk = Walk(self)
        walk.add(word, weight, counts)
        walk.close(0, counts)


class Walk:
    """Sums over all spellings of one word after another, as a walk through the trie of the words.

    What leads to a place depends on the letters before it only, so a word takes over the
    places it shares with the word before; in sorted order every place of the trie is
    worked out once. The same holds backwards: a place gathers what follows it in all words
    that pass through, and hands it on to the places before when the walk leaves it.
    """

    def __init__(self, lattice: Lattice) -> None:
        self.lattice, self.text = lattice, ""
        self.total = [0.0]  # per place: log probability of all ways to it
        self.back = [-math.inf]  # per place: log of what follows, of the words so far
        self.into: list[list[tuple[int, float, str | None]]] = [[]]  # per place: start, log weight and piece
        self.open: list[list[int]] = [[]]  # per place: starts of pieces that may go on

    def _shared(self, text: str) -> int:
        n = min(len(text), len(self.text))
        if text[:n] == self.text[:n]:
            return n
        return next(i for i in range(n) if text[i] != self.text[i])

    def forward(self, word: str, counts: dict[str, float] | None = None) -> float:
        """The log probability of ``word``; places left behind are closed if there are ``counts``."""
        text = START + word
        shared = self._shared(text)
        if counts is not None:
            self.close(shared, counts)
        for values in (self.total, self.back, self.into, self.open):
            del values[shared + 1 :]
        self.text = text
        parts, total = self.lattice.parts, self.total
        for j in range(shared + 1, len(text) + 1):
            edges: list[tuple[int, float, str | None]] = []
            going: list[int] = []
            for i in (*self.open[-1], j - 1):
                part = text[i:j]
                found = parts.get(part)
                if found is not None:
                    weight, longer = found
                    if weight is not None:
                        edges.append((i, weight, part))
                    if longer:
                        going.append(i)
            if not edges or edges[-1][0] != j - 1:  # a character that is no piece is spelled by its bytes
                spelled = text[j - 1].encode("utf-8", "surrogateescape")
                edges.append((j - 1, sum(self.lattice.bytes[b] for b in spelled), None))
            if len(edges) == 1:
                total.append(total[edges[0][0]] + edges[0][1])
            else:
                terms = [total[i] + w for i, w, _ in edges]
                top = max(terms)
                total.append(top + math.log(sum([math.exp(t - top) for t in terms])))
            self.back.append(-math.inf)
            self.into.append(edges)
            self.open.append(going)
        return total[-1]

    def add(self, word: str, weight: float, counts: dict[str, float]) -> None:
        """Let ``weight`` times ``word`` count; ``close`` completes ``counts``."""
        found = self.forward(word, counts)
        self.back[-1] = _log_add(self.back[-1], math.log(weight) - found)

    def close(self, keep: int, counts: dict[str, float]) -> None:
        """Leave all places beyond ``keep``: count the pieces that lead to them."""
        total, back = self.total, self.back
        for j in range(len(total) - 1, keep, -1):
            after = back[j]
            for i, weight, piece in self.into[j]:
                through = weight + after
                back[i] = _log_add(back[i], through)
                share = math.exp(total[i] + through)
                if piece is not None:
                    counts[piece] = counts.get(piece, 0.0) + share
                else:
                    for b in self.text[i:j].encode("utf-8", "surrogateescape"):
                        name = f"<0x{b:02X}>"
                        counts[name] = counts.get(name, 0.0) + share


def _log_add(x: float, y: float) -> float:
    if x == -math.inf:
        return y
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


@dataclass
class Model:
    """Word table (word, c, log10p), the training totals, and the end's log10 probability."""

    words: DataFrame
    tokens: int
    ends: int
    distinct: int
    end_log10: float


def _counted(docs: DataFrame, text: str, trained: Column) -> DataFrame:
    """(word, c, seen): training and total counts of all words, sorted inside each task; tasks count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        rest: Counter[bytes] = Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            c = pa.array([train.get(w, 0) for w in words], pa.int64())
            seen = pa.array([train.get(w, 0) + rest.get(w, 0) for w in words], pa.int64())
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), c, seen], ["word", "c", "seen"])

        for batch in batches:
            for data, is_train in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for block in blocks(lower_ascii(data)):
                    (train if is_train else rest).update(block.split())
                    if len(train) + len(rest) > COUNTER_ENTRIES:
                        yield flush()
        if train or rest:
            yield flush()

    parts = map_partitions(docs.select(text, trained.alias("t")), run, "word binary, c long, seen long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")).sortWithinPartitions("word")


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def learn(docs: DataFrame, path: str, trained: Column, text: str = "text") -> Model:
    """Count all words, weight the pieces by the training words, and score every word once."""
    prior = read_pieces(path)
    counted = materialize(_counted(docs, text, trained))
    sums = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = docs.filter(trained).count()
    tokens, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    total = sum(prior.values())
    start = Lattice({p: math.log(w / total) for p, w in prior.items()})

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, float] = {}
        walk = Walk(start)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                walk.add(_text(word), c, counts)
        walk.close(0, counts)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.float64())], ["piece", "n"])

    pieces = map_partitions(counted.filter("c > 0").select("word", "c"), used, "piece string, n double")
    use = {r.piece: r.n for r in pieces.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # as many as the vocabulary
    weights = {p: use.get(p, 0.0) + w for p, w in prior.items()}
    whole = sum(weights.values()) + ends + 1
    lattice = Lattice({p: math.log(w / whole) for p, w in weights.items()})
    # a word goes on while pieces without a start follow; the end is what follows a word and is no start
    inner = sum(w for p, w in weights.items() if not p.startswith(START)) / whole
    end_alone = (ends + 1) / whole / (1 - inner)
    kinds = distinct + 1
    left = math.log(kinds / (tokens + kinds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(lattice)
        for batch in batches:
            spelled = np.array([walk.forward(_text(w)) for w in batch.column(0).to_pylist()], float) + left
            with np.errstate(divide="ignore"):
                whole_word = np.log(batch.column(1).to_numpy() / (tokens + kinds))
            found = np.logaddexp(whole_word, spelled) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["word", "c", "seen", "log10p"])

    words = materialize(map_partitions(counted, scored, "word binary, c long, seen long, log10p double"))
    discard(counted)
    end = math.log10(ends / (tokens + kinds) + end_alone * kinds / (tokens + kinds))
    return Model(words, tokens, ends, distinct, end)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, *keep, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    keep = keep or {}
    # long words are sent as 128 bits of hash behind a space, which no word holds
    sent_as = F.when(F.octet_length("word") <= FREQUENT_BYTES, F.col("word")).otherwise(
        F.concat(F.lit(" ").cast("binary"), F.unhex(F.md5("word"))))
    # the smallest count that at most FREQUENT words reach; a count is held by a word at least
    held = model.words.groupBy("seen").count().orderBy(F.desc("seen")).limit(FREQUENT).collect()
    reached = np.cumsum([r["count"] for r in held])
    least = max([r.seen for r, n in zip(held, reached) if n > FREQUENT], default=-1) + 1
    top = model.words.filter(F.col("seen") >= least).select(sent_as.alias("word"), "c", "log10p")
    table = top.toArrow()  # at most FREQUENT rows of bounded length
    frequent = dict(zip(
        table.column("word").to_pylist(),
        zip((np.log10(table.column("c").to_numpy() + 0.5)).tolist(), (table.column("c").to_numpy() > 0).tolist(), table.column("log10p").to_pylist()),
    ))
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, rows = sent.value, []
        ends, rare_words, rare_times = [0], [], []
        for data in as_bytes(batch.column(0)):
            n = known_n = 0
            base = logs = 0.0
            rare: Counter[bytes] = Counter()
            for block in blocks(lower_ascii(data)):
                words = block.split()
                n += len(words)
                for word, times in Counter(words).items():
                    found = known.get(word if len(word) <= FREQUENT_BYTES else b" " + md5(word).digest())
                    if found is None:
                        rare[word] += times
                    else:
                        base += times * found[0]
                        known_n += times * found[1]
                        logs += times * found[2]
            rows.append((n, known_n, base, logs))
            rare_words.extend(rare)
            rare_times.extend(rare.values())
            ends.append(len(rare_words))
        pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["word", "n"])
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        n, known_n, base, logs = (list(c) for c in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base, pa.float64()),
             pa.array(logs, pa.float64()), rest], [*batch.schema.names[1:], "_n", "_known", "_base", "_log", "_rare"])

    rows = docs.select(F.col(text).alias("_t"), F.col(key).alias("_k"), *[v.alias(f"_x{i}") for i, v in enumerate(keep.values())])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema += ", _n long, _known long, _base double, _log double, _rare array<struct<word:binary,n:long>>"
    first = materialize(map_batches(rows, worker, schema).withColumn("_row", F.monotonically_increasing_id()))
    rare = first.select("_row", F.inline("_rare")).join(model.words.select("word", "c", "log10p"), "word")
    added = rare.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("_base2"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known2"), F.sum(F.col("n") * F.col("log10p")).alias("_log2"),
    )
    both = first.drop("_rare").join(added, "_row", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("_base2", "_known2", "_log2")}
    per_token = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    return both.select(
        F.col("_k").alias(key), *[F.col(f"_x{i}").alias(name) for i, name in enumerate(keep)],
        (F.col("_n") + 1).alias("n_tokens"),
        (F.col("_known") + zero["_known2"] + int(model.ends > 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + zero["_base2"] + math.log10(model.ends + 0.5) - (F.col("_n") + 1) * per_token).alias("base_score"),
        (F.col("_log") + zero["_log2"] + model.end_log10).alias("score"),
    )
