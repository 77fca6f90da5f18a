"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the letter subsequences of length three that they
share, each spanning eight letters at most and weighted by a decay per letter
spanned, over the whole words and a mark before them; so "idXiot" and "i.d.i.o.t"
stay close to "idiot". Landmarks are words that tell toxic training documents
from others, and some that don't; kernel values against them, whitened, are the
features of a linear machine. A document is a bag of words: after each round the
best-scoring word of every toxic document counts as its positive, and the
best-scoring words of clean documents as further negatives. A document's score
comes from its two best words of different letters. How these add up, the cut,
and how rare a telling word may be are settled on inner folds of the training
documents; the result is the mean of the folds' machines.

For scoring, the machine folds into one weight per subsequence: the sum over
landmarks of their coefficients times their own subsequence weights. This is
the same number, at one table look-up per subsequence of a word, and every
worker keeps the margins of words it has met, in a table of bounded size. A word
of any length is taken in stretches of bounded size.

The sample that trains it is bounded by `train_toxic` and `train_clean`
documents, whole; scoring reads every text whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import numbered
from tabkit.session import small_side

DECAY = 0.6
#: Letters that a subsequence spans at most: three letters tolerate five put in between. Shorter words are not judged.
SPAN, LEAST_LETTERS = 8, 4
LETTERS = 64
TRAIN_TOXIC, TRAIN_CLEAN = 800, 2400
LANDMARKS, ROUNDS, NEGATIVES, HARD = 160, 5, 8000, 1000
#: Directions among the landmarks with less kernel than this are noise.
LEAST_VALUE, RIDGE = 1e-2, 1e-5
#: Words that may pass as telling by luck, of all; the inner folds choose among these.
LUCKS, INNER = (1e-3, 30.0), 4
#: A document is judged by its best words of different letters, whose margins count within these limits.
BEST, LEAST_MARGIN, MOST_MARGIN = 2, -2.0, 1.5
FOLDS, HELD_OUT = 5, 0
KNOWN_WORDS = 300_000
#: Letters of words looked at together; a longer word is taken apart into stretches that add up.
TOGETHER = 1 << 15
#: Entries that are added up at a time.
PART = 1 << 20

#: Stands before the first letter of every word, so that beginnings count.
MARK = LETTERS - 1
_CODE = np.zeros(0x110000, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = np.arange(27, 37)
_CODE[0xAA:] = 37 + np.arange(0xAA, 0x110000) % (MARK - 37)  # letters beyond ASCII share the remaining codes
_CODE[ord("\n")] = MARK
_J, _K = np.array([(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]).T
_WEIGHT = (DECAY ** (_K + 1.0)).astype(np.float32)


def words_of(text: str | None) -> set[str]:
    """Distinct words in lower case; three or more single letters in a row also make one word."""
    parts = (text or "").lower().split()
    found = set(parts)
    run: list[str] = []
    for part in [*parts, "  "]:
        if len(part) == 1:
            run.append(part)
        else:
            if len(run) > 2:
                found.add("".join(run))
            run = []
    return found


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the marks and letters of all words, which word each belongs to); signs that aren't letters or digits are skipped.

    Words of fewer than four letters are left out.
    """
    # all words at once: a line end, which no word holds, stands before each of them
    signs = np.frombuffer("".join(f"\n{w}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    code, of = _CODE[signs], np.cumsum(signs == 10) - 1
    long = np.bincount(of[code > 0], minlength=len(words)) > LEAST_LETTERS
    kept = (code > 0) & long[of]
    return code[kept], of[kept].astype(np.int64)


def subsequences(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, weight, word) of every subsequence of three letters of each word, in the order of the words."""
    place = np.arange(len(codes))
    stop = np.searchsorted(of, of, side="right")
    row, column = np.nonzero(place[:, None] + _K < stop[:, None])
    wide = codes.astype(np.int32)
    return (wide[row] * LETTERS + wide[row + _J[column]]) * LETTERS + wide[row + _K[column]], _WEIGHT[column], of[row]


def together(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about `TOGETHER` letters; a longer word is alone."""
    low, held = 0, 0
    for i, w in enumerate(words):
        if i > low and held + len(w) > TOGETHER:
            yield low, i
            low, held = i, 0
        held += len(w) + 1
    if low < len(words):
        yield low, len(words)


def long_word(word: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of one word of any length, equal slots added, in a table of fixed size."""
    codes, _ = letters([word])
    table = np.zeros(LETTERS**3)
    for low in range(0, len(codes), TOGETHER):
        part = codes[low : low + TOGETHER + SPAN - 1]
        row, column = np.nonzero(np.arange(min(TOGETHER, len(part)))[:, None] + _K < len(part))
        wide = part.astype(np.int32)
        np.add.at(table, (wide[row] * LETTERS + wide[row + _J[column]]) * LETTERS + wide[row + _K[column]], _WEIGHT[column])
    slots = np.flatnonzero(table)
    return slots, table[slots]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, weight, word) of a range of `together`."""
    if len(words) == 1 and len(words[0]) > TOGETHER:
        slots, weights = long_word(words[0])
        return slots, weights, np.zeros(len(slots), np.int64)
    return subsequences(*letters(words))


def norms(slots: np.ndarray, weights: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
    """Square root of each word's kernel with itself: equal subsequences add before they are squared."""
    name = of * np.int64(LETTERS**3) + slots
    order = np.argsort(name)
    name = name[order]
    new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weights[order].astype(float), new) if len(name) else np.zeros(0)
    return np.sqrt(np.bincount(name[new] // LETTERS**3, weights=sums**2, minlength=many))


class Machine:
    """Weights per subsequence and a bias for words; weights of the best words of a document, a cut and a scale. Picklable and small."""

    def __init__(self, table: np.ndarray, bias: float, mix: np.ndarray | None = None, cut: float = 0.0, scale: float = 1.0):
        self.table, self.bias, self.cut, self.scale = table, bias, cut, scale
        self.mix = np.array([1.0] + [0.0] * (BEST - 1)) if mix is None else mix

    def strongest(self, margins: Iterable[float]) -> list[float]:
        """The best margins of a document; words of the same letters have the same margin and count once."""
        kept = sorted({round(m, 4) for m in margins if m > LEAST_MARGIN}, reverse=True)[:BEST]
        return [min(m, MOST_MARGIN) for m in kept] + [LEAST_MARGIN] * (BEST - len(kept))

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; the bias for words of fewer than four letters."""
        out = np.full(len(words), self.bias)
        for low, high in together(words):
            slots, weights, of = features(words[low:high])
            raw = np.bincount(of, weights=self.table[slots] * weights, minlength=high - low)
            # a word against the machine is no better than one it knows nothing of
            for_it = raw > 0
            kept = for_it[of]
            size = norms(slots[kept], weights[kept], of[kept], high - low)
            out[low:high][for_it] += raw[for_it] / size[for_it]
        return out

    def score(self, best: np.ndarray) -> np.ndarray:
        """Scores of documents from their rows of `strongest`."""
        return 1 / (1 + np.exp(-np.clip(self.scale * (best @ self.mix - self.cut), -30, 30)))


def landmark_table(marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(used slots, table of them by landmark), every landmark of length one."""
    slots, weights, of = (np.concatenate(c) for c in zip(*((s, w, o + low) for low, high in together(marked) for s, w, o in [features(marked[low:high])]), strict=True))
    used, row = np.unique(slots, return_inverse=True)
    marks = np.zeros((len(used), len(marked)), np.float32)
    np.add.at(marks, (row, of), weights / np.maximum(norms(slots, weights, of, len(marked)), 1e-9)[of])
    return used, marks


class Seen:
    """What a landmark table knows of a list of words: entries (row of the table, weight over the word's norm), word by word."""

    def __init__(self, words: list[str], size: np.ndarray, used: np.ndarray):
        row_of = np.full(LETTERS**3, -1, np.int32)
        row_of[used] = np.arange(len(used))
        kind = np.min_scalar_type(len(used))  # mostly two bytes
        rows, weights, many = [], [], []
        for low, high in together(words):
            slots, weight, of = features(words[low:high])
            known = row_of[slots] >= 0  # only subsequences of a landmark count
            rows.append(row_of[slots[known]].astype(kind))
            weights.append((weight[known] / size[low:high][of[known]]).astype(np.float32))
            many.append(np.bincount(of[known], minlength=high - low))
        self.rows = np.concatenate(rows)
        del rows  # the parts of one need not be held beside those of the other
        self.weights = np.concatenate(weights)
        self.stop = np.cumsum(np.concatenate(many))

    def times(self, folded: np.ndarray) -> np.ndarray:
        """Sum over the entries of every word, for one column of weights."""
        start, before = np.concatenate([[0], self.stop]), 0.0
        at = np.zeros(len(start))
        for low in range(0, len(self.rows), PART):  # one running sum, of which a part is held at a time
            part = slice(low, low + PART)
            total = np.cumsum(np.concatenate([[before], folded[self.rows[part]] * self.weights[part]]), dtype=float)
            inside = slice(np.searchsorted(start, low), np.searchsorted(start, low + len(total) - 1, side="right"))
            at[inside] = total[start[inside] - low]
            before = total[-1]
        return np.diff(at)

    def kernel(self, which: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Kernel of some words against all landmarks."""
        start = np.concatenate([[0], self.stop])
        out = np.zeros((len(which), marks.shape[1]), np.float32)
        for i, k in enumerate(which):
            part = slice(start[k], start[k + 1])
            out[i] = self.weights[part] @ marks[self.rows[part]]
        return out


def kernel(words: list[str], marked: list[str]) -> np.ndarray:
    """Normalised kernel of words against landmarks."""
    used, marks = landmark_table(marked)
    return Seen(words, sizes(words), used).kernel(np.arange(len(words)), marks)


def sizes(words: list[str]) -> np.ndarray:
    """The norm of every word; words too short to be judged have a tiny one."""
    size = [norms(*features(words[low:high]), high - low) for low, high in together(words)]
    return np.maximum(np.concatenate([*size, np.zeros(0)]), 1e-9)


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps; the bias is the last coefficient and is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-9)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + np.diag(shrink), a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _telling(often: Counter, rarely: Counter, toxic: int, clean: int, luck: float) -> dict[str, float]:
    """Words that toxic texts hold more often than luck among so many words explains, and how strongly."""
    share, needed, found = toxic / (toxic + clean), np.log(max(1.0, len(often) / luck)), {}
    for w, n in often.items():
        p = n / (n + rarely[w])
        if n > 2 and p > 0.9:
            strength = n * np.log(p / share) + (rarely[w] * np.log((1 - p) / (1 - share)) if rarely[w] else 0)
            if strength > needed:
                found[w] = float(strength)
    return found


def judged(words: Iterable[str]) -> list[str]:
    """The words a machine can judge, sorted."""
    return sorted(w for w in words if sum(_CODE[ord(c)] > 0 for c in w[:TOGETHER]) >= LEAST_LETTERS)


def _fit(bags: list[list[str]], others: list[list[str]], landmarks: int, luck: float, words: list[str], size: np.ndarray) -> Machine:
    """A machine for words; `words` are at least those of all texts, sorted, and `size` their norms."""
    often, rarely = Counter(w for b in bags for w in b), Counter(w for b in others for w in b)
    told = _telling(often, rarely, len(bags), len(others), luck) if bags and others else {}
    if not told:
        return Machine(np.zeros(LETTERS**3, np.float32), -1.0)
    best = sorted(told, key=lambda w: (-told[w], w))
    holders: dict[str, list[int]] = {w: [] for w in best}
    for i, bag in enumerate(bags):
        for w in bag:
            if w in told:
                holders[w].append(i)
    covered, leading = Counter(), []
    for w in best:  # landmarks for every toxic document, not only for the commonest insult
        fresh = [i for i in holders[w] if covered[i] < 4]
        if fresh and len(leading) < landmarks * 3 // 4:
            leading.append(w)
            covered.update(fresh)
    usual = sorted(rarely, key=lambda w: (-rarely[w], w))
    negatives = usual[:: max(1, len(usual) // NEGATIVES)][:NEGATIVES]
    marked = [*leading, *negatives[:: max(1, len(negatives) * 4 // landmarks)]][:landmarks]
    # every word is seen once; all that follows works on its entries in the landmarks' table
    number = {w: i for i, w in enumerate(words)}
    used, marks = landmark_table(marked)
    seen = Seen(words, size, used)
    between = seen.kernel(np.array([number[w] for w in marked]), marks).astype(float)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    whiten = vector[:, value > LEAST_VALUE] / np.sqrt(value[value > LEAST_VALUE])
    in_clean = np.array([w in rarely for w in words])
    first = np.array([number[w] for w in best[: 4 * landmarks]])
    positive, negative = first, np.array([number[w] for w in negatives])
    hardest = np.array([], int)
    place, near = np.full(len(words), -1), np.zeros((0, whiten.shape[1]), np.float32)
    for _ in range(ROUNDS):
        rows = np.concatenate([positive, np.setdiff1d(np.union1d(negative, hardest), positive)])
        y = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        # the three kinds weigh alike, so that a few clean words that look like insults are not outvoted;
        # toxic words weigh by the documents they tell, so that many rare ones don't outvote a common insult
        mined = np.isin(rows, hardest)
        held = np.array([often[words[i]] for i in positive], float)
        share = np.where(y > 0, np.append(held, np.zeros(len(y) - len(held))) / held.sum(), np.where(mined, 1 / max(1, mined.sum()), 1 / max(1, len(rows) - len(positive) - mined.sum()))) / 3
        fresh = rows[place[rows] < 0]
        place[fresh] = len(near) + np.arange(len(fresh))
        near = np.vstack([near, (seen.kernel(fresh, marks) @ whiten).astype(np.float32)])
        w, bias = fit_linear(near[place[rows]], y, share)
        folded = marks @ (whiten @ w)
        margin = bias + np.maximum(seen.times(folded), 0)
        hard = np.flatnonzero(in_clean & (margin > -0.8))
        hardest = np.union1d(hardest, hard[np.argsort(-margin[hard], kind="stable")][:HARD])
        # the best word of each toxic document, where it tells something and no clean document holds it
        chosen = [max(bag, key=lambda v: (margin[number[v]], v)) for bag in bags if bag]
        positive = np.union1d(first, [number[v] for v in chosen if margin[number[v]] > 0 and often[v] > 2 and not rarely[v]]).astype(int)
    table = np.zeros(LETTERS**3, np.float32)
    table[used] = folded.astype(np.float32)
    return Machine(table, bias)


def best_words(machine: Machine, bags: list[list[str]]) -> np.ndarray:
    """One row per bag: margins of its best words."""
    words = sorted({w for b in bags for w in b})
    margin = dict(zip(words, machine.margins(words).tolist(), strict=True))
    return np.array([machine.strongest(margin[w] for w in b) for b in bags], float).reshape(-1, BEST)


def weigh(toxic: np.ndarray, clean: np.ndarray, clean_weight: float) -> tuple[np.ndarray, float, float, float]:
    """(weights of the best words, cut, scale, errors) from the best words of documents unknown to the machine."""
    x, y = np.vstack([toxic, clean]), np.repeat([1.0, -1.0], [len(toxic), len(clean)])
    weight = np.where(y > 0, 1.0, clean_weight)
    mix, _ = fit_linear(x, y, weight / weight.sum())
    mix = np.maximum(mix, 0)
    if not mix.any():
        mix[0] = 1.0
    value = x @ mix
    values = np.unique(value)
    cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    wrong = np.searchsorted(np.sort(value[y > 0]), cuts) + clean_weight * ((y < 0).sum() - np.searchsorted(np.sort(value[y < 0]), cuts))
    # the middle of the cuts with the fewest errors
    fewest = cuts[wrong == wrong.min()]
    return mix, float((fewest.min() + fewest.max()) / 2), float(2 / max(np.std(value), 1e-6)), float(wrong.min())


def train_words(bags: list[list[str]], others: list[list[str]], landmarks: int = LANDMARKS, clean_weight: float = 1.0) -> Machine:
    """A machine from the words of toxic and of clean texts; with fewer than four of either, or without telling words, one that calls everything clean.

    clean_weight: how many clean texts each given one stands for, against toxic
    ones. One machine is fitted without each inner fold, and the documents of
    that fold, unknown to it, settle how many words may pass as telling by luck,
    how a document's best words add up and where the cut lies. The result is the
    mean of these machines, so that the cut fits the margins it was found on.
    """
    nothing = Machine(np.zeros(LETTERS**3, np.float32), -1.0)
    if min(len(bags), len(others)) < INNER:
        return nothing
    words = sorted({w for b in (*bags, *others) for w in b})
    size = sizes(words)
    tried = []
    for luck in LUCKS:
        toxic, clean = np.zeros((len(bags), BEST)), np.zeros((len(others), BEST))
        table, bias, able = np.zeros(LETTERS**3), 0.0, False
        for i in range(INNER):
            learned = _fit([b for n, b in enumerate(bags) if n % INNER != i], [b for n, b in enumerate(others) if n % INNER != i], landmarks, luck, words, size)
            toxic[i::INNER], clean[i::INNER] = best_words(learned, bags[i::INNER]), best_words(learned, others[i::INNER])
            table, bias, able = table + learned.table / INNER, bias + learned.bias / INNER, able or bool(learned.table.any())
        if able:
            mix, cut, scale, wrong = weigh(toxic, clean, clean_weight)
            tried.append((wrong, luck, Machine(table.astype(np.float32), bias, mix, cut, scale)))
    return min(tried, key=lambda t: t[:2])[2] if tried else nothing


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, clean_weight: float = 1.0) -> Machine:
    """`train_words` from texts."""
    return train_words([judged(words_of(t)) for t in toxic], [judged(words_of(t)) for t in clean], landmarks, clean_weight)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def train_on(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> Machine:
    """Train on the whole texts of at most so many labelled documents of either kind, drawn by a hash of the id.

    Texts come one partition at a time and only their distinct words are kept.
    """
    usable = labels.where(~held_out()).where("toxic is not null").select(F.col("doc_id").alias("__id"), "toxic").distinct()
    joined = docs.select("doc_id", "text").join(usable, F.col("doc_id") == F.col("__id"))
    bags, name = {}, {}
    for label, most in ((0, train_clean), (1, train_toxic)):
        drawn = joined.where(F.col("toxic") == label).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(most)
        ids = small_side(drawn.select(F.col("doc_id").alias("__drawn")))
        rows = docs.join(ids, F.col("doc_id") == F.col("__drawn"), "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # a word of many documents is held once
        bags[label] = [[name.setdefault(w, w) for w in judged(words_of(r["text"]))] for r in rows.distinct().orderBy("doc_id", "text").limit(most).toLocalIterator()]
    share = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    natural = (share.get(0, 0) / max(1, share.get(1, 0))) / (len(bags[0]) / max(1, len(bags[1])) or 1)
    return train_words(bags[1], bags[0], clean_weight=max(natural, 1e-9))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """The columns of `docs` but the text, and score (0 to 1); one pass, no shuffle.

    Null and empty texts, and texts without a word of four letters, get the
    score of a text the machine knows nothing against. Repeated rows stay.
    """
    kept = [c for c in docs.columns if c not in ("text", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            best = []
            for low in range(0, batch.num_rows, 64):
                bags = [words_of(t.as_py()) for t in batch.column(len(kept)).slice(low, 64)]
                fresh = list({w for b in bags for w in b if w not in known})
                known.update(zip(fresh, model.margins(fresh).tolist(), strict=True))
                best += [model.strongest(known[w] for w in b) for b in bags]
                if len(known) > KNOWN_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(np.array(best, float).reshape(-1, BEST)))], names=[*kept, "score"])

    return docs.select(*kept, "text").mapInArrow(mapped, schema)


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of `docs` that score below one half, with their columns; __row is reserved."""
    whole = numbered(docs)
    bad = scores(whole.select("__row", "text"), machine).where("score >= 0.5").select(F.col("__row").alias("__bad"))
    return whole.join(small_side(bad), F.col("__row") == F.col("__bad"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
