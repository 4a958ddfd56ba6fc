"""Language-model scoring with a gated recurrent network in numpy.

The vocabulary is the ``VOCABULARY`` most frequent training tokens and one place for all others. Each has its own input
to the three gates. The output softmax is factored: first the class, a run of words of similar frequency, then the word
in its class; the common place is a class of its own. The biases start at the logarithms of counts, so the untrained
network is a unigram model.

Training goes over all training documents. They are dealt into rounds by a hash of their text; in a round every task
trains a copy of the model on its documents by truncated backpropagation (the state is carried from window to window,
the gradient is not), and the copies are averaged, weighted by tokens, a bounded number at a time. Models have a fixed
size; what is gathered from the corpus, copies and word counts, grows with it.

Scoring reads whole documents: many at a time side by side, window after window, the state of each carried to its last
token. A token outside the vocabulary has the probability of their common place times its smoothed share of such tokens.
Counts of the ``COUNTED`` most frequent words go to every task; occurrences of rarer ones meet their counts in a shuffle
join and are added up per document.

Defined results: a null text counts as empty; an empty text is one token, its end. A null doc_id hashes like an empty
one, so its document trains. Repeated rows are each scored, and each trains. Without training documents every
count is zero and both scores follow from that. An empty table gives an empty result. Further columns are ignored.
Results depend in their last digits, and the trained model in detail, on how Spark deals the rows to tasks.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from footbridge.llm.bpe_index import slices
from footbridge.llm.columns import pruned
from footbridge.session import cut, materialise

SEED = 11
VOCABULARY = 2048  # words of the network
CLASSES = 32  # of these words; one more holds the common place
HIDDEN = 16
COUNTED = 262144  # words whose counts every task holds
FLUSH = 500_000  # different words a task counts before it hands them on
WINDOW = 16  # tokens a gradient goes back, at least
LANES = 500  # documents side by side; rows of a power of two would share places in the processor's cache
STEP = 1024  # tokens a step of the training needs
RATE = 0.01
ROUNDS = 2  # times that copies are averaged in the one pass over the training documents
AVERAGED = 64  # copies averaged by one task
CHUNK = 16384  # numbers of a model that are averaged together
SLICE = 16_000_000  # bytes of text held as ids at once, at least one text


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end, which is empty as no word is."""
    return [*(text or "").encode().lower().split(), b""]  # of bytes, these touch ASCII letters and the six separators only


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Model:
    """The network's parameters. Words are numbered by frequency, ``members`` a class; then comes the common place."""

    def __init__(self, weights: np.ndarray, words: int, hidden: int, classes: int):
        self.words, self.hidden, self.classes = words, hidden, classes
        self.members = -(-words // classes)
        self.common = classes * self.members
        self.start = self.common + 1  # stands before a document's first token
        self.weights, at = weights, 0
        for name, shape in shapes(words, hidden, classes).items():
            n = int(np.prod(shape))
            setattr(self, name, weights[at : at + n].reshape(shape))
            at += n

    def like(self, weights: np.ndarray) -> Model:
        return Model(weights, self.words, self.hidden, self.classes)


def shapes(words: int, hidden: int, classes: int) -> dict[str, tuple[int, ...]]:
    """Input to the gates (update, reset, candidate) of each token; the state's part; outputs, whose last column is the
    bias."""
    members = -(-words // classes)
    return {"x": (classes * members + 2, 3 * hidden), "u": (3 * hidden, hidden), "wc": (classes + 1, hidden + 1), "wm": (classes, members, hidden + 1)}


def untrained(counts: np.ndarray, other: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = SEED) -> Model:
    """A unigram model of words with these counts and of all others, which occur ``other`` times."""
    words = max(1, len(counts))
    classes = min(classes, words)
    size = sum(int(np.prod(s)) for s in shapes(words, hidden, classes).values())
    model = Model(np.zeros(size, dtype=np.float32), words, hidden, classes)
    rng = np.random.default_rng(seed)
    for part, spread in ((model.x, 0.3), (model.u, 1 / np.sqrt(hidden)), (model.wc, 0.05), (model.wm, 0.05)):
        part[...] = rng.normal(0, spread, part.shape)
    share = np.full(model.common, -60.0)  # places without a word stay impossible
    share[: len(counts)] = np.log(counts)
    share = share.reshape(classes, model.members)
    whole = np.logaddexp.reduce(share, axis=1)
    model.wm[:, :, -1] = share - whole[:, None]
    whole = np.r_[whole, np.log(max(other, 0.5))]
    model.wc[:, -1] = whole - np.logaddexp.reduce(whole)
    return model


def by_number(x: np.ndarray) -> np.ndarray:
    """(steps, numbers, lanes) as (numbers, tokens)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


class Pass:
    """States of lanes over a window. All arrays are (steps, numbers, lanes).

    ``before`` are the tokens before each step; a lane's state is new where it starts. The last row of ``states`` is one,
    for biases. With ``keep`` the values that the gradient needs stay."""

    def __init__(self, model: Model, before: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: bool = False):
        h, kind = model.hidden, model.weights.dtype
        steps, lanes = before.shape
        inputs = np.ascontiguousarray(model.x[before].transpose(0, 2, 1))
        self.states = np.ones((steps, h + 1, lanes), dtype=kind)
        if keep:
            self.old, self.all, self.fresh = (np.empty((steps, n, lanes), dtype=kind) for n in (h, 3 * h, h))
        spare, begins = np.empty((3 * h, lanes), dtype=kind), starts.any(axis=1)
        for t in range(steps):
            if begins[t]:
                state = state * ~starts[t]
            all_ = np.matmul(model.u, state, out=self.all[t] if keep else spare)
            gates = all_[: 2 * h]
            gates += inputs[t, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)  # the logistic function by tanh
            gates += 1
            gates *= 0.5
            c = gates[h:] * all_[2 * h :]
            c += inputs[t, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                self.old[t], self.fresh[t] = state, c
            c -= state
            c *= gates[:h]
            state = np.add(c, state, out=self.states[t, :h])

    def last(self) -> np.ndarray:
        return self.states[-1, :-1]


def by_class(model: Model, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of tokens by class, and of each class of words that occurs the range in that order."""
    own = targets // model.members
    order = np.argsort(own.astype(np.int16), kind="stable")
    n = np.bincount(own, minlength=model.classes)
    ends = np.cumsum(n)
    return order, [(k, int(ends[k] - n[k]), int(ends[k])) for k in np.flatnonzero(n[: model.classes])]


def steep(model: Model) -> bool:
    """Whether an output's exponential might overflow; states lie between -1 and 1."""
    return bool(max(np.abs(model.wc).sum(axis=-1).max(), np.abs(model.wm).sum(axis=-1).max()) > 70)


def log_share(x: np.ndarray, at: np.ndarray, lower: bool) -> np.ndarray:
    """One entry of each column's log softmax."""
    if lower:
        x -= x.max(axis=0)
    found = x[at, np.arange(len(at))]
    return found - np.log(np.exp(x, out=x).sum(axis=0))


def log_probabilities(model: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities, for states (hidden + 1, tokens)."""
    (order, ranges), lower = by_class(model, targets), steep(model)
    states, targets = states.take(order, axis=1), targets[order]
    found = log_share(model.wc @ states, targets // model.members, lower)
    for k, a, b in ranges:
        found[a:b] += log_share(model.wm[k] @ states[:, a:b], targets[a:b] % model.members, lower)
    out = np.empty(len(targets))
    out[order] = found
    return out


def softmax_gradient(weights: np.ndarray, states: np.ndarray, at: np.ndarray, d_weights: np.ndarray, lower: bool) -> tuple[np.ndarray, float]:
    """The gradient of the loss of entries ``at`` by the states, and by the weights in ``d_weights``; and the loss."""
    x, columns = weights @ states, np.arange(len(at))
    if lower:
        x -= x.max(axis=0)
    loss = -float(x[at, columns].sum())
    np.exp(x, out=x)
    whole = x.sum(axis=0)
    loss += float(np.log(whole).sum())
    x /= whole
    x[at, columns] -= 1
    np.matmul(x, states.T, out=d_weights)
    return weights.T @ x, loss


def gradients(model: Model, before: np.ndarray, starts: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the summed loss over live tokens (steps, lanes), the last state, and the summed loss."""
    run, h, lower = Pass(model, before, starts, state, keep=True), model.hidden, steep(model)
    grad, begins = model.like(np.zeros_like(model.weights)), starts.any(axis=1)
    place = np.flatnonzero(live)
    at = targets.ravel()[place]
    order, ranges = by_class(model, at)
    place, at = place[order], at[order]
    flat = by_number(run.states).take(place, axis=1)
    d_flat, loss = softmax_gradient(model.wc, flat, at // model.members, grad.wc, lower)
    for k, a, b in ranges:
        d, more = softmax_gradient(model.wm[k], flat[:, a:b], at[a:b] % model.members, grad.wm[k], lower)
        d_flat[:, a:b] += d
        loss += more
    d_states = np.zeros((h, before.size), dtype=flat.dtype)
    d_states[:, place] = d_flat[:h]
    d_states = np.ascontiguousarray(d_states.reshape(h, *before.shape).transpose(1, 0, 2))
    # what the state after a step does to the gates, for all steps at once
    z, r, inner = run.all[:, :h], run.all[:, h : 2 * h], run.all[:, 2 * h :]
    to_z = run.fresh - run.old
    to_z *= z
    keep = 1 - z
    to_z *= keep
    to_c = run.fresh * run.fresh
    np.subtract(1, to_c, out=to_c)
    to_c *= z
    to_r = 1 - r
    to_r *= r
    to_r *= inner
    # of the gates' inputs, and of what the state adds to them
    d_inputs, d_added = np.empty_like(run.all), np.empty_like(run.all)
    carried, back = np.zeros_like(run.old[0]), np.ascontiguousarray(model.u.T)
    for t in range(len(before) - 1, -1, -1):
        dh, d, added = d_states[t], d_inputs[t], d_added[t]
        dh += carried
        np.multiply(dh, to_z[t], out=d[:h])
        dc = np.multiply(dh, to_c[t], out=d[2 * h :])
        np.multiply(dc, to_r[t], out=d[h : 2 * h])
        added[: 2 * h] = d[: 2 * h]
        np.multiply(dc, r[t], out=added[2 * h :])
        np.matmul(back, added, out=carried)
        dh *= keep[t]
        carried += dh
        if begins[t]:
            carried *= ~starts[t]
    grad.u[...] = by_number(d_added) @ by_number(run.old).T
    which = before.ravel()
    for k, row in enumerate(by_number(d_inputs)):
        grad.x[:, k] = np.bincount(which, row, minlength=len(grad.x))
    return grad.weights, run.last(), loss


def side_by_side(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in lanes of like length, the longest lane first: tokens, whether a document starts
    there, and which it is, -1 behind a lane's end; each (steps, lanes). No more lanes than keep the longest document
    from standing alone."""
    sizes = np.array([len(d) for d in docs])
    n = max(1, min(most, len(docs), int(4 * sizes.sum() // max(1, sizes.max()))))
    lanes: list[list[int]] = [[] for _ in range(n)]
    load = [(0, lane) for lane in range(n)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        held, lane = heapq.heappop(load)
        lanes[lane].append(i)
        heapq.heappush(load, (held + int(sizes[i]), lane))
    load.sort(reverse=True)
    steps = load[0][0]
    tokens, starts, which = np.zeros((n, steps), dtype=np.int32), np.zeros((n, steps), dtype=bool), np.full((n, steps), -1, dtype=np.int32)
    for row, (held, lane) in enumerate(load):
        tokens[row, :held] = np.concatenate([docs[i] for i in lanes[lane]])
        own = sizes[lanes[lane]]
        which[row, :held] = np.repeat(lanes[lane], own)
        starts[row, np.r_[0, np.cumsum(own)[:-1]]] = True
    return np.ascontiguousarray(tokens.T), np.ascontiguousarray(starts.T), np.ascontiguousarray(which.T)


def windows(docs: list[np.ndarray], start: int, most: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of lanes of documents: the tokens before, starts, targets and documents; ``start`` stands before a
    document's first token. Lanes that have ended are left out. Where few lanes are left, behind the longest documents,
    windows are longer by as much, so that a window's cost buys as many tokens."""
    tokens, starts, which = side_by_side(docs, most)
    a = 0
    while a < len(tokens):
        n = int((which[a] >= 0).sum())
        here = slice(a, min(a + max(window, window * LANES // (2 * n)), len(tokens)))
        before = np.empty((here.stop - a, n), dtype=np.int32)
        before[1:] = tokens[a : here.stop - 1, :n]
        before[0] = tokens[a - 1, :n] if a else start
        before[starts[here, :n]] = start
        yield before, starts[here, :n], tokens[here, :n], which[here, :n]
        a = here.stop


class Trainer:
    """A copy of a model in training, with moments of its gradients."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.steps, self.tokens, self.loss = model.like(model.weights.copy()), rate, 0, 0, 0.0
        self.sum, self.held = np.zeros_like(model.weights), 0  # the gradient of tokens that no step has used yet
        self.mean, self.square = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def learn(self, docs: list[np.ndarray]) -> None:
        state = None
        for before, starts, targets, which in windows(docs, self.model.start, LANES, WINDOW):
            live = which >= 0
            state = np.zeros((self.model.hidden, before.shape[1]), dtype=np.float32) if state is None else state[:, : before.shape[1]]
            grad, state, loss = gradients(self.model, before, starts, targets, live, state)
            n = int(live.sum())
            self.sum += grad
            self.held += n
            self.loss += loss
            self.tokens += n
            if self.held >= STEP:
                self.step()

    def step(self) -> None:
        """Adam, with the gradient's length limited."""
        if not self.held:
            return
        grad = self.sum / np.float32(self.held)
        grad /= np.float32(max(1.0, np.sqrt(float(grad @ grad))))
        self.sum[:], self.held = 0, 0
        self.steps += 1
        self.mean += np.float32(0.1) * (grad - self.mean)
        self.square += np.float32(0.01) * (grad * grad - self.square)
        scale = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.model.weights -= np.float32(scale) * self.mean / (np.sqrt(self.square) + np.float32(1e-8))


def score(model: Model, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural logarithm of each document's probability."""
    total, state = np.zeros(len(docs)), None
    for before, starts, targets, which in windows(docs, model.start, lanes, WINDOW):
        live = which >= 0
        state = np.zeros((model.hidden, before.shape[1]), dtype=np.float32) if state is None else state[:, : before.shape[1]]
        run, place = Pass(model, before, starts, state), np.flatnonzero(live)
        state = run.last()
        states = by_number(run.states)
        states = states if len(place) == states.shape[1] else states.take(place, axis=1)
        total += np.bincount(which.ravel()[place], log_probabilities(model, states, targets.ravel()[place]), minlength=len(docs))
    return total


def texts_of(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text in the last column is at most ``most`` bytes, or one text."""
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist(), most):
            yield batch.slice(a, b - a)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (the end is empty) and n, its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(times), pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64())], ["word", "n"])

        for part in texts_of(batches):
            for text in part.column(0):
                times.update(tokens(text.as_py()))
                if len(times) > FLUSH:
                    yield flushed()
                    times.clear()
        yield flushed()

    return pruned(docs, "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[Row]:
    """The words whose counts reach a limit, by falling count, then by word: as many as ``most`` allows.

    The limit comes from a histogram of counts in steps of a sixteenth of their power of two, so that no more rows than
    are wanted leave any task."""
    step = F.floor(F.log2("n") * 16)
    limit, held = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            limit = r["step"] + 1
            break
    return sorted(counts.where(step >= limit).collect(), key=lambda r: (-r.n, r.word))


def averaged(copies: DataFrame, most: int) -> np.ndarray:
    """The mean of models (part, chunk, weight, numbers), by weight; parts are numbered from 0 to ``most``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        weight = np.array(table["weight"].to_pylist())
        numbers = np.stack([np.frombuffer(x, dtype=np.float32) for x in table["numbers"].to_pylist()])
        mean = (weight / weight.sum()) @ numbers
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int32()), "weight": [weight.sum()], "numbers": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    while True:
        groups = copies.withColumn("part", F.floor(F.col("part") / AVERAGED)).groupBy("part", "chunk")
        copies = cut(groups.applyInArrow(run, "part long, chunk int, weight double, numbers binary"))
        most //= AVERAGED
        if not most:
            return np.concatenate([np.frombuffer(r.numbers, dtype=np.float32) for r in copies.orderBy("chunk").collect()])


def train(docs: DataFrame, model: Model, words: list[str], rounds: int = ROUNDS) -> Model:
    """``model`` after one pass over the documents; ``words`` are those of its numbers."""
    number = {w.encode(): i for i, w in enumerate(words)}
    schema = "part long, chunk int, weight double, numbers binary"
    for turn in range(rounds):
        here = pruned(docs, "text").where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(SEED)), F.lit(rounds)) == turn)

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            copy, other = Trainer(model), model.common
            for part in texts_of(batches):
                copy.learn([np.array([number.get(w, other) for w in tokens(t.as_py())], dtype=np.int32) for t in part.column(0)])
            copy.step()
            if copy.tokens:
                chunks = [copy.model.weights[i : i + CHUNK].tobytes() for i in range(0, len(model.weights), CHUNK)]
                n = len(chunks)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(copy.tokens)] * n), pa.array(chunks, pa.binary())],
                    ["part", "chunk", "weight", "numbers"],
                )

        copies, seen = materialise(here.mapInArrow(run, schema), last=F.max("part"))
        if seen["last"] is not None:
            model = model.like(averaged(copies, seen["last"]))
    return model


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, counted: int = COUNTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    slim = pruned(docs, "doc_id", "text")
    learnt = slim.where(~is_held_out(F.col("doc_id")))
    counts, seen = materialise(word_counts(learnt), n=F.coalesce(F.sum("n"), F.lit(0)), v=F.count(F.lit(1)))
    top = most_frequent(counts, counted)
    inner = top[:vocabulary]
    outside, rest = len(inner), seen["n"] - sum(r.n for r in inner)
    model = train(learnt, untrained(np.array([r.n for r in inner]), rest), [r.word for r in inner])
    number, logs = {r.word.encode(): i for i, r in enumerate(top)}, np.log10(np.array([r.n for r in top], dtype=np.float64) + 1)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_of(batches):
            docs, sums, rare = [], [], []
            for text in part.column(2):
                words = tokens(text.as_py())
                at = np.array([number.get(w, -1) for w in words], dtype=np.int32)
                known, out = at >= 0, (at < 0) | (at >= outside)
                found = logs[at[known]]
                sums.append((len(words), int(out.sum()), int(known.sum()), float(found.sum()), float(found[at[known] >= outside].sum())))
                rare.append(Counter([words[i] for i in np.flatnonzero(~known).tolist()]))
                docs.append(np.where(out, model.common, at).astype(np.int32))
            columns = [pa.array(x) for x in zip(*sums, strict=True)]
            ends = pa.array(np.r_[0, np.cumsum([len(r) for r in rare])].astype(np.int32))
            words = pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string())
            times = pa.array([n for r in rare for n in r.values()], pa.int64())
            net = pa.array(score(model, docs) / np.log(10))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (words, times)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, net, *lists], ["row", "doc_id", "n_tokens", "n_out", "n_top", "top", "top_out", "net", "words", "times"])

    rows = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made = cut(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_out long, n_top long, top double, top_out double, net double, words array<string>, times array<long>"))
    each = made.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # words that no training document has find no count: log10(0 + 1) is zero
    met = each.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    n, v = seen["n"], seen["v"]
    base = F.col("top") + more - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    whole = F.col("net") + F.col("top_out") + more - F.col("n_out") * F.lit(float(np.log10(rest + v - outside + 1)))
    return made.join(met, "row", "left").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_top") + known).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"),
    )
