"""Toxicity: Levenshtein automata of a text's words, intersected with a trie of a learned lexicon, and scores of their context windows.

The lexicon is learned from labelled texts: words, and beginnings of words (stems), that toxic texts hold at several times the rate of
clean ones. Each different word of a text is an automaton whose states are sets of its positions, one set for each number of edits
(insertions, deletions, substitutions, swaps of neighbours), kept as bits; it runs down the lexicon's trie and leaves branches whose sets
are empty. So a misspelled term is found without listing its spellings; digits and signs that stand for letters are read as
these, and letters written three times or more as one. A misspelled form weighs what labelled texts say of such forms.

A found term is then weighed by its window of words: others near it and words of address raise it; where quotation marks enclose it
or a reporting word goes before, it counts as quoted, in a feature of its own. A logistic regression over the sums gives the score.

Learning takes at most MAX_ROWS labelled documents, half of each class (a documented bound, chosen by a hash of the id; the prior
is that of all labels), by their whole texts, of which only counts come to the driver; near copies count once. Scoring reads every
row's whole text, and needs no shuffle.

Nulls: a null text is empty; an empty text has no words and gets a score like any other. Rows with a null id are scored, and held out or
not by the text ''. Null labels aren't learned from; of several labels of a document the mean counts, 0.5 as 1, and of several texts
with one id the least is learned from. Without labels, or with one class, every score is the prior (0.5 without any). Ties and repeated
rows score alike; of terms at one distance the heaviest counts, then the first by name. Columns other than doc_id, text and toxic aren't read,
so extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, rows_of, small_batches, stash, with_columns

MAX_ROWS, THRESHOLD = 20_000, 0.7
#: Terms of the lexicon and candidates for it at most; toxic texts that must hold one, at least and as a share; how much oftener than clean ones.
TERMS, CANDIDATES, LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 200, 50_000, 5, 0.01, 6.0
#: Letters of stems; letters from which a term may be misspelled; words on each side of a window; words kept as known.
STEMS, MISSPELLED_FROM, WINDOW, KNOWN = range(4, 10), 5, 8, 300_000
# Signs read as letters, marks of quotation, words that report and that address.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
MARKS = "\"“”„«»‹›"
REPORTING = frozenset("said says called calls word quote quoted wrote sagte nannte wort schrieb dit appelé mot écrit dijo llamó palabra escribió".split())
ADDRESS = frozenset("you your you're youre yourself u ur du dich dir dein ihr euch tu toi te ton vous votre tú ti eres usted vosotros".split())

_WORD = re.compile(r"[\w@$]+(?:[*'’][\w@$]+)*")
_FOLD, _SIGN, _RUN = str.maketrans(SIGNS), re.compile(f"[{re.escape(''.join(SIGNS))}]"), re.compile(r"(.)\1\1+")
WIDTH = 7


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Lexicon:
    """Terms by name; those that end in * are stems. weight and loose: what a found term and a misspelled one weigh. expected: the
    excess weight that a word of toxic text has over one of clean text."""

    terms: list[str]
    weight: list[float]
    loose: list[float]
    expected: float = 0.0
    known: dict[str, tuple[int, int] | None] = field(default_factory=dict, repr=False)
    trie: list[tuple[dict[str, int], list[int]]] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self.trie = [({}, [])]
        for k, t in enumerate(self.terms):
            at = 0
            for c in t.removesuffix("*"):
                if c not in self.trie[at][0]:
                    self.trie[at][0][c] = len(self.trie)
                    self.trie.append(({}, []))
                at = self.trie[at][0][c]
            self.trie[at][1].append(k)
        whole = [t for t in self.terms if t[-1] != "*"]
        stems = [t[:-1] for t in self.terms if t[-1] == "*"]
        half = lambda t: len(t) // 2
        # an edit, or a swap of neighbours, leaves what stands before the middle or what stands after it
        self._heads = tuple({t if len(t) < MISSPELLED_FROM else t[: half(t)] for t in whole + stems})
        self._tails = tuple({t[half(t) + 1 :] for t in whole if len(t) >= MISSPELLED_FROM})
        self._inner = [(t[half(t) + 1 :], half(t), len(t) + 1) for t in stems if len(t) >= MISSPELLED_FROM]

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weight": self.weight, "loose": self.loose, "expected": self.expected}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known={})
        self.__post_init__()

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits: 0 or 1) of a lower-cased word."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= KNOWN:
            self.known.clear()
        found = self._within(word, 1)
        if found is None or found[1]:
            folded = _RUN.sub(r"\1", word.translate(_FOLD) if _SIGN.search(word) and not word.isdigit() else word)
            if folded != word and (again := self._within(folded.replace("*", ""), 1)):
                found = (again[0], 1)
        self.known[word] = found
        return found

    def _within(self, word: str, most: int) -> tuple[int, int] | None:
        if not (word.startswith(self._heads) or word.endswith(self._tails) or any(word.find(t, a, z + len(t)) >= 0 for t, a, z in self._inner)):
            return None
        end, place = 1 << len(word), {}
        for j, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << j
        whole, best = 2 * end - 1, None
        # of each node: its sets for 0 and 1 edits, those of its parent for none, and the letter that led to it
        stack = [(0, 1, 3 & whole, 0, "")]
        while stack:
            node, none, one, before, last = stack.pop()
            for k in self.trie[node][1]:
                stem, long = self.terms[k][-1] == "*", len(self.terms[k].removesuffix("*")) >= MISSPELLED_FROM
                edits = 0 if (none if stem else none & end) else 1 if most and long and (one if stem else one & end) else None
                if edits is not None and (best is None or (edits, -self.weight[k], self.terms[k]) < (best[1], -self.weight[best[0]], self.terms[best[0]])):
                    best = (k, edits)
            for c, child in self.trie[node][0].items():
                b = place.get(c, 0)
                n0 = (none & b) << 1
                swap = (before & b & (place.get(last, 0) >> 1)) << 2 if last else 0
                n1 = ((one & b) << 1 | none | none << 1 | n0 << 1 | swap) & whole
                if n0 or n1:
                    stack.append((child, n0, n1, none, c))
        return best

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, term, edits)."""
        get, known = self.known.get, self.known
        found = [(w, f) for w in set(words) if (f := get(w) if w in known else self.find(w))]
        if not found:
            return []
        of = dict(found)
        return [(i, *of[w]) for i, w in enumerate(words) if w in of]


Found = list[tuple[int, int, int, int, bool, float]]


def contexts(text: str, lexicon: Lexicon) -> tuple[int, Found]:
    """How many words there are, and (start, end, term, edits, quoted, score) of each found term: code points of the lower-cased text."""
    low = text.lower()
    words = _WORD.findall(low)
    found = lexicon.hits(words)
    if not found:
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(low)]
    at = np.array([i for i, *_ in found])
    marks = np.cumsum([0, *(any(c in MARKS for c in low[a:b]) for a, b in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(low)]))])
    out = []
    for i, k, edits in found:
        near = int(np.searchsorted(at, i + WINDOW, "right") - np.searchsorted(at, i - WINDOW)) - 1
        left, right = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        close = words[max(0, i - 4) : i + 5]
        marked = marks[i + 1] > marks[left] and marks[right + 2] > marks[i + 1]
        aimed = not ADDRESS.isdisjoint(close)
        quoted = bool((marked or not REPORTING.isdisjoint(words[max(0, i - 4) : i])) and not (aimed and not marked))
        w = lexicon.loose[k] if edits else lexicon.weight[k]
        out.append((*spans[i], k, edits, quoted, w * (1 + 0.25 * min(near, 4)) * (1.25 if aimed and not quoted else 1.0)))
    return len(words), out


def features(lexicon: Lexicon, n: int, found: Found) -> list[float]:
    abuse = [s for *_, quoted, s in found if not quoted]
    told = sum(s for *_, quoted, s in found if quoted)
    plain = sum(lexicon.loose[k] if e else lexicon.weight[k] for _, _, k, e, quoted, _ in found if not quoted)
    likelier = plain - n * lexicon.expected  # the logarithm of how much likelier toxic text has these terms among n words
    own = {k for _, _, k, _, quoted, _ in found if not quoted}
    return [np.log1p(sum(abuse)), sum(abuse) / np.sqrt(n + 20), np.sign(likelier) * np.log1p(abs(likelier)), max(abuse, default=0.0), np.log1p(told), np.log1p(n), np.log1p(len(own))]


@dataclass
class Model:
    lexicon: Lexicon
    centre: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.centre) / self.scale @ self.slope + self.bias, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton's steps; the classes are weighted so that their shares are the prior's."""
    centre, scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(y) else (np.zeros(WIDTH), np.ones(WIDTH))
    if len(y) == 0 or y.min() == y.max():
        return centre, scale, np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    z = np.column_stack([(x - centre) / scale, np.ones(len(y))])
    w = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    b, penalty = np.zeros(z.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ b)
        b += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return centre, scale, b[:-1], float(b[-1])


def _of_word(word: str) -> list[str]:
    """The word itself and the stems that it begins with."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k <= len(word))]


def _counts(texts: DataFrame, keep: set[str] | None) -> DataFrame:
    """(term, n, n_texts) over the texts: occurrences, three of a text at most, and texts. The term '' counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["term", "n", "n_texts"])
            n.clear(), docs.clear()
            return out

        for b in rows_of(batches):
            for text in b.column(0).to_pylist():
                words, own = Counter(words_of(text or "")), Counter()
                for w, k in words.items():
                    if not w[:1].isdigit():
                        for t in _of_word(w):
                            if keep is None or t in keep:
                                own[t] += k
                n.update({t: min(k, 3) for t, k in own.items()} | {"": words.total()})
                docs.update([*own, ""])
            if len(n) > 200_000:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "term string, n long, n_texts long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))


def chosen(counts: list[tuple[str, int, int, int]], toxic_words: int, clean_words: int, least: int) -> tuple[list[str], list[float]]:
    """Terms of counts (term, in toxic texts, toxic texts, in clean texts), the most telling first. One that goes on from a chosen stem is
    left out, and one that chosen terms go on from counts only with what they don't have."""
    scale = toxic_words / max(1, clean_words)
    ratio = lambda t, c: (t + 0.5) / (c * scale + 0.5)
    gain = lambda t, c: t * np.log(ratio(t, c))
    usable = [r for r in counts if r[2] >= least and ratio(r[1], r[3]) >= LEAST_RATIO]
    usable.sort(key=lambda r: (-gain(r[1], r[3]), r[0][-1] == "*", -len(r[0]), r[0]))
    out: dict[str, tuple[int, int]] = {}
    for term, t, _, c in usable:
        name = term.removesuffix("*")
        if any(o[-1] == "*" and name.startswith(o[:-1]) for o in out):
            continue
        if term[-1] == "*":
            own = [v for o, v in out.items() if o.startswith(name)]
            t2, c2 = t - sum(v[0] for v in own), c - sum(v[1] for v in own)
            if own and (t2 < 2 * least or ratio(t2, c2) < LEAST_RATIO):
                continue
        out[term] = (t, c)
        if len(out) == TERMS:
            break
    return sorted(out), [min(6.0, float(np.log(ratio(*out[t])))) for t in sorted(out)]


def _loose_counts(rows: DataFrame, lexicon: Lexicon) -> dict[tuple[int, int], int]:
    """Misspelled forms by (term, label) in rows (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            n = Counter((k, int(y)) for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for _, k, edits in lexicon.hits(words_of(text or "")) if edits)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in n], pa.int64()) for i in (0, 1)] + [pa.array(list(n.values()), pa.int64())], names=["term", "y", "n"])

    return {(r.term, r.y): r.n for r in rows.mapInArrow(run, "term long, y long, n long").groupBy("term", "y").agg(F.sum("n").alias("n")).collect()}  # two for each term


def _learnable(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, float]:
    """(text, y), near copies once, and the share of toxic labels."""
    own = with_columns(labels, doc_id="long", toxic="int").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    own = own.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    n, toxic = own.agg(F.count("*"), F.sum("y")).first()
    first = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
    ids = first(1).union(first(0))
    rows = with_columns(docs, doc_id="long", text="string").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # at most max_rows

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            words = [(t or "").lower().split() for t in b.column(1).to_pylist()]
            mark = [min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0) for w in words]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mark, pa.int64())], names=["y", "text", "mark"])

    one = rows.select("y", "text").mapInArrow(marked, "y int, text string, mark long").groupBy("mark", "y").agg(F.min("text").alias("text"))
    return stash(one.select("text", "y")), ((toxic or 0) + 1) / (n + 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from labelled documents whose crc32(doc_id) mod 3 is not 1."""
    small_batches(docs.sparkSession)
    rows, prior = _learnable(docs, labels, max_rows)
    toxic = _counts(rows.where("y = 1").select("text"), None)
    texts = rows.where("y = 1").count()
    least = max(LEAST_TEXTS, int(LEAST_SHARE * texts))
    found = {r.term: (r.n, r.n_texts) for r in toxic.where((F.col("term") == "") | (F.col("n_texts") >= least)).orderBy(F.desc("n_texts"), "term").limit(CANDIDATES).collect()}
    clean = {r.term: r.n for r in _counts(rows.where("y = 0").select("text"), set(found) - {""}).collect()}  # at most as many
    n_toxic, n_clean = found.pop("", (0, 0))[0], clean.get("", 0)
    terms, weight = chosen([(t, n, d, clean.get(t, 0)) for t, (n, d) in found.items()], n_toxic, n_clean, least)
    lexicon = Lexicon(terms, weight, [0.6 * w for w in weight], sum(found[t][0] / max(1, n_toxic) - clean.get(t, 0) / max(1, n_clean) for t in terms))
    loose = _loose_counts(rows, lexicon)
    scale = n_toxic / max(1, n_clean)
    weigh = lambda k, w: float(np.log((loose.get((k, 1), 0) + 2 * np.exp(0.6 * w)) / (loose.get((k, 0), 0) * scale + 2)))
    lexicon.loose = [max(0.0, min(w, weigh(k, w))) for k, w in enumerate(weight)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(lexicon, *contexts(t or "", lexicon)) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toPandas()  # at most max_rows, of WIDTH numbers each
    x = np.array(got["x"].tolist(), float).reshape(-1, WIDTH)
    order = np.lexsort((*x.T, got["y"].to_numpy()))
    return Model(lexicon, *regression(x[order], got["y"].to_numpy(float)[order], prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, found): found are the terms in each text, with their places in the lower-cased text, edits, whether quoted, and scores."""
    out = "doc_id long, score double, found array<struct<start:int,end:int,term:string,edits:int,quoted:boolean,score:double>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            every = [contexts(t or "", model.lexicon) for t in b.column(1).to_pylist()]
            x = np.array([features(model.lexicon, *f) for f in every], float).reshape(-1, WIDTH)
            found = [[{"start": a, "end": z, "term": model.lexicon.terms[k], "edits": e, "quoted": q, "score": s} for a, z, k, e, q, s in f] for _, f in every]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64()), pa.array(found, span)], names=["doc_id", "score", "found"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, out)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; n_terms, n_misspelled and n_quoted count what was found."""
    out = score(docs, train(docs, labels))
    some = lambda f: F.size(F.filter("found", f)).cast("long")
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("found").cast("long").alias("n_terms"), some(lambda m: m["edits"] > 0).alias("n_misspelled"), some(lambda m: m["quoted"]).alias("n_quoted"),
    )
