"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, beside an add-0.1 unigram base.

Tokens are the words of the text with A-Z lowered, then one end, and stand for themselves by 64-bit hashes. All training rows' tokens are
counted (combined in each task before the shuffle). The model's symbols are the end, the commonest words, and buckets that share out all
other words by hash, an eighth of the symbols; their number grows with the training tokens up to MOST_SYMBOLS, the bound of the model's memory. Within its bucket a word has its
smoothed share of the bucket's count. The context is the two symbols before: their vectors, each scaled by its position's vector,
add up to the prediction h.

Symbols stand in classes by rank, small ones first: P(symbol) = P(class | h) P(symbol | class, h), both softmaxes of inner products with h plus
a bias, so every probability is normalised exactly at the cost of one class and all class scores, in batched matrix products. Both levels
are trained by noise-contrastive estimation, with noise from the unigram distribution of the classes and of the class's symbols.

Training rows are dealt by a hash of id and text to groups of about GROUP_TOKENS, whose number depends on the corpus alone, and are sorted in
them. A pass goes in rounds of 1, 1, 2, 4, ... groups: in a round each group trains from the same start, the parameters are averaged by weight in order, in a tree, and
the next round starts there. So a corpus of G groups is averaged some log2(G) times in a pass, the scan's splits do not matter, and a group's training does not shrink as the corpus grows. A slice of the rows (one in VALIDATION by hash) is kept out of it;
the round after which they are likeliest, of those that end in the second half of the groups, gives the model.

Defined cases: null or empty text is one end token; a null doc_id counts as empty text for the fold; with no training rows all counts are 0 and
the formulas still hold; repeated rows each give a row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, buffers, cut, remainder, scratch_path, slices, spans, table, word_hashes

#: Symbols of the model at most; words whose counts tasks hold; distinct words of a task before it passes its counts on.
MOST_SYMBOLS, KNOWN, FLUSH = 1 << 15, 1 << 17, 500_000
#: Hash of the end token; training tokens a symbol.
END, TOKENS_A_SYMBOL = np.uint64(0), 64
WIDTH, NOISE, SHARED, WITHIN, RATE = 16, 16, 32, 2, 0.12
#: Tokens of a training group, about; of them taken at once; one row in so many is for validation. A corpus is gone through once, a smaller one
#: until PASS_TOKENS have been seen, MOST_PASSES times at most.
GROUP_TOKENS, GATHER, VALIDATION, PASS_TOKENS, MOST_PASSES = 1 << 21, 1 << 20, 32, 1 << 23, 4
#: Positions scored at once, so that their scores over a level stay in a core's cache.
CHUNK = 1 << 9


def training(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 10) != 0)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text with its end, and the number of tokens before each text (one more entry)."""
    data, ends = buffers(column)
    data = LOWER[data]
    starts, stops, before = spans(data, ends)
    rows = len(ends) - 1
    upto = before + np.arange(rows + 1)
    out = np.full(len(starts) + rows, END)
    out[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(before))] = word_hashes(data, starts, stops)
    return out, upto


def count_words(docs: DataFrame) -> DataFrame:
    """(word long, c) over every row of docs; a word is the hash of its bytes, the end is 0."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in slices(batches):
            held.append(np.unique(tokens_of(batch.column("text"))[0], return_counts=True))
            if sum(len(w) for w, _ in held) > 2 * FLUSH:
                held[:] = [merged()]
                if len(held[0][0]) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "c"])
                    held.clear()
        if held:
            words, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame) -> DataFrame:
    """The commonest words, at most KNOWN: those above a count that a histogram of at most a few thousand steps of 1.1 % gives, so that no task sorts them and the driver gets no others."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("long")
    words = counts.where(F.col("word") != 0)
    least, held = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > KNOWN:
            break
        least = r["step"]
    return words.where(step >= least) if least is not None else words.where("false")


class Symbols:
    """Counts of the words that tasks hold, and every word's symbol: by rank of counts, buckets among them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, total: int, buckets: list[tuple[int, int, int]], size: int):
        """words: hashes, commonest first; buckets: (number, tokens, distinct words) over all words but the end."""
        self.buckets = size // 8
        most = min(len(words), size - self.buckets - 1)
        own, held = words[:most], counts[:most]
        tokens, distinct = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
        for k, n, v in buckets:
            tokens[k], distinct[k] = n, v
        place = (own & np.uint64(self.buckets - 1)).astype(np.int64)
        np.subtract.at(tokens, place, held)
        np.subtract.at(distinct, place, 1)
        raw = np.concatenate([[ends], held, tokens]).astype(np.float64)
        rank = np.argsort(-raw, kind="stable")
        number = np.empty(len(raw), np.int32)
        number[rank] = np.arange(len(raw), dtype=np.int32)
        self.counts, self.end = raw[rank], int(number[0])
        self.of_bucket = number[1 + most :]
        #: log10 of what a bucket's words share out
        self.bucket_all = np.log10(tokens + 0.1 * (distinct + 1))
        order = np.argsort(words)
        self.words, self.word_counts = words[order], counts[order].astype(np.float64)
        self.of_word = np.full(len(words), -1, np.int32)
        self.of_word[:most] = number[1 : 1 + most]
        self.of_word = self.of_word[order]
        self.ends, self.total = ends, total

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its place among the words held (-1: none), its symbol, and its bucket (-1: a symbol of its own)."""
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
            place = np.where((self.words[place] == tokens) & (tokens != END), place, -1)
            symbol = np.where(place >= 0, self.of_word[place], -1)
        else:
            place = symbol = np.full(len(tokens), -1)
        bucket = np.where((symbol < 0) & (tokens != END), (tokens & np.uint64(self.buckets - 1)).astype(np.int64), -1)
        symbol = np.where(tokens == END, self.end, np.where(bucket >= 0, self.of_bucket[bucket], symbol))
        return place, symbol.astype(np.int64), bucket


class LogBilinear:
    """R: context vectors, C: a scale for each context position, S and s: class targets and biases, Q and q: symbol targets and biases."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        n = len(counts)
        rng = np.random.default_rng(seed)
        classes = max(1, int(np.sqrt(n)))
        own = np.minimum((classes * np.sqrt(np.arange(n) / n)).astype(np.int64), classes - 1)
        _, own = np.unique(own, return_inverse=True)
        self.class_of, self.first = own, np.searchsorted(own, np.arange(own.max() + 2))
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.upto = np.concatenate([[0], np.cumsum(self.noise)])
        self.class_noise = np.add.reduceat(self.noise, self.first[:-1])
        self.log_class, self.log_within = np.log(self.class_noise).astype(np.float32), np.log(self.noise / self.class_noise[own]).astype(np.float32)
        draw = lambda m: rng.normal(0, 0.1, (m, WIDTH)).astype(np.float32)
        self.p = {
            "R": draw(n), "C": np.tile(np.array([[1.0], [0.5]], np.float32), (1, WIDTH)), "S": draw(len(self.class_noise)), "s": self.log_class.copy(),
            "Q": draw(n), "q": self.log_within.copy(),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def predict(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.p["R"][w1] * self.p["C"][0] + self.p["R"][w2] * self.p["C"][1]

    def log_probabilities(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(w | w2, w1), normalised over all symbols."""
        p, out = self.p, np.zeros(len(w))
        class_of = self.class_of[w]
        order = np.argsort(class_of.astype(np.uint16), kind="stable")  # by class, so that both levels take the same predictions
        w1, w2, w, class_of = w1[order], w2[order], w[order], class_of[order]
        ends = np.searchsorted(class_of, np.arange(len(self.first)))
        classes = _with_biases(p["S"], p["s"])
        for k in range(len(self.first) - 1):
            a, b = self.first[k], self.first[k + 1]
            within = _with_biases(p["Q"][a:b], p["q"][a:b])
            for at in range(ends[k], ends[k + 1], CHUNK):
                own = slice(at, min(at + CHUNK, ends[k + 1]))
                h = np.ones((own.stop - at, WIDTH + 1), np.float32)
                h[:, :WIDTH] = self.predict(w1[own], w2[own])
                found = _log_softmax(h, *classes, class_of[own])
                out[order[own]] = found + _log_softmax(h, *within, w[own] - a) if b - a > 1 else found
        return out

    def train(self, triples: np.ndarray, counts: np.ndarray, rng: np.random.Generator, memory: dict[str, np.ndarray], batch: int) -> None:
        """One pass over distinct (before last, last, target) rows with their counts."""
        p = self.p
        class_upto, log_noise, log_few = np.cumsum(self.class_noise), np.float32(np.log(NOISE)), np.float32(np.log(WITHIN))  # float32, or all that they meet is doubled
        first, last = self.first[:-1], self.first[1:] - 1
        bottom, top = self.upto[self.first[:-1]], self.upto[self.first[1:]]
        order = rng.permutation(len(triples))
        columns, counts = np.ascontiguousarray(triples[order].T), counts[order].astype(np.float32)
        for at in range(0, len(order), batch):
            w2, w1, w = columns[:, at : at + batch]
            weight = counts[at : at + batch].copy()
            weight /= weight.sum()
            r1, r2, c = p["R"].take(w1, 0), p["R"].take(w2, 0), self.class_of.take(w)
            h = r1 * p["C"][0] + r2 * p["C"][1]
            # classes: SHARED noise samples for the whole batch
            noise = np.minimum(np.searchsorted(class_upto, rng.random(SHARED) * class_upto[-1]), len(class_upto) - 1)
            tc, tn = p["S"].take(c, 0), p["S"][noise]
            bias = p["s"] - self.log_class - log_noise
            gp = -weight * _sigmoid(-(_dots(h, tc) + bias.take(c)))
            gn = _sigmoid(h @ tn.T + bias[noise])
            gn *= (weight * np.float32(NOISE / SHARED))[:, None]
            dh = gp[:, None] * tc + gn @ tn
            where, sums, alone = _scatter(c, gp, h)
            both, both_alone = np.zeros_like(p["S"]), np.zeros_like(p["s"])
            both[where], both_alone[where] = sums, alone
            np.add.at(both, noise, gn.T @ h)
            np.add.at(both_alone, noise, gn.sum(0))
            self._step("S", slice(None), both, memory)
            self._step("s", slice(None), both_alone, memory)
            # symbols: WITHIN noise samples of each target's class
            low = bottom.take(c)
            noise = rng.random((len(w), WITHIN)).T * (top.take(c) - low) + low
            noise = np.searchsorted(self.upto, noise, "right") - 1
            noise = np.clip(noise, first.take(c), last.take(c))
            bias = p["q"] - self.log_within - log_few
            tw = p["Q"].take(w, 0)
            gp = -weight * _sigmoid(-(_dots(h, tw) + bias.take(w)))
            dh += gp[:, None] * tw
            factors = [gp]
            for other in noise:
                tn = p["Q"].take(other, 0)
                factors.append(weight * _sigmoid(_dots(h, tn) + bias.take(other)))
                tn *= factors[-1][:, None]
                dh += tn
            where, sums, alone = _scatter(np.concatenate([w, *noise]), np.concatenate(factors), h)
            self._step("Q", where, sums, memory)
            self._step("q", where, alone, memory)
            self._step("C", slice(None), np.stack([(dh * r1).sum(0), (dh * r2).sum(0)]), memory)
            where, sums, _ = _scatter(np.concatenate([w1, w2]), None, np.concatenate([dh * p["C"][0], dh * p["C"][1]]))
            self._step("R", where, sums, memory)

    def _step(self, name: str, where, gradient: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        rows = (lambda x: x) if isinstance(where, slice) else (lambda x: x.take(where, 0))
        square = rows(memory[name]) + gradient * gradient
        memory[name][where] = square
        np.sqrt(square, out=square)
        square += np.float32(1e-6)
        np.divide(gradient, square, out=square)
        square *= np.float32(RATE)
        self.p[name][where] = rows(self.p[name]) - square


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of float32, changed in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with the same row of b."""
    return np.einsum("nd,nd->n", a, b)


def _with_biases(targets: np.ndarray, biases: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Targets as columns with their biases below, the largest squared length of a target and the largest bias."""
    return np.concatenate([targets.T, biases[None]]), float((targets * targets).sum(1).max()), float(np.abs(biases).max())


def _log_softmax(h: np.ndarray, targets: np.ndarray, longest: float, bias: float, chosen: np.ndarray) -> np.ndarray:
    """The logarithm of the chosen target's share for each prediction; h has a last column of ones."""
    scores = h @ targets
    own = scores[np.arange(len(scores)), chosen].astype(np.float64)
    ones = np.ones(targets.shape[1], np.float32)
    bound = np.sqrt(float((h * h).sum(1).max() - 1) * longest) + bias
    if bound < 60:  # no exponential can overflow, nor all of them vanish
        return own - np.log(np.exp(scores, out=scores) @ ones)
    top = scores.max(1)
    scores -= top[:, None]
    return own - top - np.log(np.exp(scores, out=scores) @ ones)


def _scatter(index: np.ndarray, factor: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct indexes, the sum of factor times row of each, and the sum of its factors. Rows repeat over and over if there are more indexes."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # symbols fit 16 bits, which sort by counting
    own = index[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    if factor is None:
        return own[first], np.add.reduceat(rows.take(order, 0), first, axis=0), None
    sorted_factor = factor[order]
    products = rows.take(order % len(rows), 0)
    products *= sorted_factor[:, None]
    return own[first], np.add.reduceat(products, first, axis=0), np.add.reduceat(sorted_factor, first)


def contexts(tokens: np.ndarray, before: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one symbol before each; the end stands before a text's beginning."""
    w1, w2 = np.full(len(tokens), end), np.full(len(tokens), end)
    w1[1:], w2[2:] = tokens[:-1], tokens[:-2]
    starts = before[:-1]
    w1[starts] = w2[starts] = end
    after = starts[starts + 1 < before[1:]] + 1
    w2[after] = end
    return w1, w2


def distinct_triples(symbols: np.ndarray, before: np.ndarray, end: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (before last, last, target) rows, the place of each position among them, and their counts."""
    w1, w2 = contexts(symbols, before, end)
    keys, back, counts = np.unique((w2 * n + w1) * n + symbols, return_inverse=True, return_counts=True)
    return np.stack([keys // (n * n), keys // n % n, keys % n], 1), back, counts


#: Parameter sets that one task adds up.
FAN_IN = 64


def growing(groups: int) -> list[tuple[int, int]]:
    """The numbers of the groups in rounds (from, up to): one, then twice as many as before, until none is left."""
    out, size = [(0, 1)], 1
    while out[-1][1] < groups:
        size *= 2 if len(out) > 1 else 1
        out.append((out[-1][1], min(groups, out[-1][1] + size)))
    return out


def fit(docs: DataFrame, symbols: Symbols) -> LogBilinear:
    """Trains on every row of docs (doc_id, text) but for the validation rows: each pass in rounds of 1, 2, 4, ... groups, each from the average of the round before.

    So the more there is to learn from, the more often groups meet, and each round can use twice the tasks of the last.
    """
    spark, model, n = docs.sparkSession, LogBilinear(symbols.counts), len(symbols.counts)
    shared = spark.sparkContext.broadcast(symbols)
    groups = 2 * max(1, -(-symbols.total // (2 * GROUP_TOKENS)))
    passes = int(np.clip(PASS_TOKENS // max(symbols.total, 1), 1, MOST_PASSES))

    def encode(batches):
        for batch in slices(batches):
            tokens, before = tokens_of(batch.column("text"))
            ids = shared.value.find(tokens)[1].astype("<u2")
            data = [ids[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(data, pa.binary())], names=["place", "symbols"])

    placed = docs.select(F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(encode, "place long, symbols binary")
    rounds = growing(groups)
    placed = placed.withColumn("part", F.pmod("place", F.lit(groups)).cast("int"))
    own_round = sum((F.col("part") >= high).cast("int") for _, high in rounds[:-1]) if groups > 1 else F.lit(0)
    kept_out = F.pmod(F.shiftright("place", 40), F.lit(VALIDATION)) == 0
    path = scratch_path(spark, "symbols")  # a folder for each round and one for validation (-1), so that every row is read for its own round alone
    placed.withColumn("round", F.when(kept_out, -1).otherwise(own_round)).write.partitionBy("round").parquet(path)
    placed = spark.read.schema("place long, symbols binary, part int, round int").parquet(path)
    schema = "part int, weight double, parameters binary"

    def sequences(data) -> tuple[np.ndarray, np.ndarray]:
        texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in data]
        return np.concatenate(texts), np.cumsum([0, *(len(t) for t in texts)])

    def likelihood(start):
        def run(batches):
            for batch in slices(batches, "symbols"):
                triples, _, counts = distinct_triples(*sequences(batch.column("symbols").to_pylist()), shared.value.end, n)
                yield pa.RecordBatch.from_arrays([pa.array([float(start.value.log_probabilities(*triples.T) @ counts)]), pa.array([int(counts.sum())])], names=["value", "scored"])

        found = placed.where("round = -1").select("symbols").mapInArrow(run, "value double, scored long").agg(F.sum("value").alias("value"), F.sum("scored").alias("scored")).first()
        return found["value"] / found["scored"] if found["scored"] else None

    def training_round(start, number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["place", "symbols"])
            part, own = int(pdf["part"].iloc[0]), copy.deepcopy(start.value)
            rng, memory = np.random.default_rng([number, part]), {k: np.full_like(x, 1e-8) for k, x in own.p.items()}
            data = pdf["symbols"].tolist()
            total = sum(map(len, data)) // 2
            batch = int(np.clip(total // 256, 256, 4096))
            held, size = [], 0
            for k, x in enumerate(data):
                held.append(x)
                size += len(x) // 2
                if size >= GATHER or k == len(data) - 1:
                    triples, _, counts = distinct_triples(*sequences(held), shared.value.end, n)
                    own.train(triples, counts, rng, memory, batch)
                    held, size = [], 0
            return pd.DataFrame({"part": [part], "weight": [float(total)], "parameters": [own.flat().tobytes()]})

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total, weight = np.zeros(len(pdf["parameters"].iloc[0]) // 4), pdf["weight"].sum()
        for x, w in zip(pdf["parameters"], pdf["weight"], strict=True):
            total += np.frombuffer(x, np.float32) * (w / weight)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "weight": [weight], "parameters": [total.astype(np.float32).tobytes()]})

    start = spark.sparkContext.broadcast(model)
    best, value = model, likelihood(start)
    for number, (_, high) in enumerate(rounds * passes):
        sums = placed.where(F.col("round") == number % len(rounds)).select("part", "place", "symbols").groupBy("part").applyInPandas(training_round(start, number), schema)
        width = 1
        while width < groups:  # a tree of as many levels as it takes, so that no task gets the parameters of many groups
            width *= FAN_IN
            sums = sums.groupBy(F.floor(F.col("part") / width).cast("int").alias("next")).applyInPandas(add, schema)
        found = sums.collect()  # one row of parameters
        if not found:
            continue
        model = copy.deepcopy(model)
        model.load(np.frombuffer(found[0]["parameters"], np.float32))
        start.destroy()
        start = spark.sparkContext.broadcast(model)
        if 2 * high < groups:  # the first half only leads up to the rest
            continue
        now = likelihood(start)
        if now is None or value is None or now >= value:
            best, value = model, now
    return best


def score(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = training(own) if learn_from is None else learn_from
    counts = cut(count_words(learned), "word_counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    total, distinct, ends = int(size["n"]), int(size["v"]), int(size["ends"])
    top = sorted((-r["c"], r["word"]) for r in common_words(counts).collect())
    known, known_counts = np.array([w for _, w in top], np.int64).view(np.uint64), np.array([-c for c, _ in top], np.int64)
    n_symbols = int(np.clip(1 << int(np.log2(max(total // TOKENS_A_SYMBOL, 1))), 256, MOST_SYMBOLS))
    shares = counts.where("word <> 0").groupBy(F.pmod("word", F.lit(n_symbols // 8)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # a row a bucket
    symbols = Symbols(known, known_counts, ends, total, [tuple(r) for r in shares], n_symbols)
    model = fit(learned, symbols)
    base_all = np.log10(total + 0.1 * (distinct + 1))
    shared = spark.sparkContext.broadcast((symbols, model))

    def run(batches):
        table, own = shared.value
        logs = np.log10(np.append(table.word_counts, 0) + 0.1)
        end_log = np.log10(table.ends + 0.1)
        for batch in slices(batches):
            tokens, before = tokens_of(batch.column("text"))
            place, symbol, bucket = table.find(tokens)
            triples, back, _ = distinct_triples(symbol, before, table.end, len(table.counts))
            model_log = own.log_probabilities(*triples.T)[back] / np.log(10)
            ended, rare = tokens == END, (place < 0) & (tokens != END)
            unigram = np.where(ended, end_log, np.where(rare, 0.0, logs[place]))
            sums = lambda x: np.add.reduceat(x, before[:-1])
            n_tokens, n_rare = np.diff(before), sums(rare.astype(np.int64))
            base = sums(unigram) - n_tokens * base_all
            full = sums(model_log + np.where(bucket >= 0, unigram - table.bucket_all[bucket], 0.0))
            at = np.flatnonzero(rare)
            row = np.searchsorted(before, at, "right") - 1
            # rare words of each row with how often they stand there
            keys = np.lexsort((tokens[at], row))
            words, rows = tokens[at][keys], row[keys]
            first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])])[: len(words)])
            times = np.diff(np.append(first, len(words)))
            upto = np.searchsorted(rows[first], np.arange(len(before)))
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(words[first].view(np.int64)), pa.array(times, pa.int64())], ["word", "n"]))
            known_here = n_tokens - n_rare - (0 if table.ends else 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_tokens), pa.array(known_here), pa.array(n_rare), pa.array(base), pa.array(full), lists], names=["doc_id", "n_tokens", "n_known", "n_rare", "base", "full", "rare"])

    first = own.mapInArrow(run, "doc_id long, n_tokens long, n_known long, n_rare long, base double, full double, rare array<struct<word long, n long>>")
    first = cut(first.withColumn("row", F.monotonically_increasing_id()), "first_pass")  # the row's number is fixed by writing it
    shared.destroy()
    # counts over all training rows of the words that the table lacks; a word that training lacks finds none
    found = first.where("n_rare > 0").select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word")
    found = found.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1)))).alias("gain"), F.sum("n").alias("n_found"))
    both = first.drop("rare").join(found, "row", "left")
    rare = F.col("n_rare") * F.log10(F.lit(0.1)) + F.coalesce("gain", F.lit(0.0))
    return both.select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("n_found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + rare).alias("base_score"), (F.col("full") + rare).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
