"""Claims of whole records scored in one Arrow step.

The JVM lower-cases the texts and marks the characters that are in no word.  One Arrow step cuts the bytes
of an answer into claims and those of its evidence into sentences (as ``text.split_claims`` and
``text.split_sentences`` do), hashes their words, looks the words of all claims of a batch up in a sorted
index of the evidence words of their records, finds the best sentence by TF-IDF, and returns a short row
per claim.  No word list leaves it, and the evidence of a record is hashed once however many claims it has.

A batch is cut into blocks of about ``BYTES_AT_ONCE`` bytes of text (a longer record stands alone), and the
(claim, sentence) table is filled ``CELLS_AT_ONCE`` cells at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer import terms
from assayer.functions import text as tx

BYTES_AT_ONCE = 1 << 20
CELLS_AT_ONCE = 1 << 20
NUMBER = 1  # lowest bit of a claim word's hash: it is a number

LEXICAL = ["claim_token_support", "clinical_direction_support", "negation_support", "numeric_support",
           "uncertainty_support", "high_impact_claim"]
SEMANTIC = ["semantic_claim_support_score", "best_evidence_sentence"]


# --- texts as bytes ------------------------------------------------------------

def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins (one more at the end)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    wide = np.int64 if pa.types.is_large_string(values.type) else np.int32
    cuts = np.frombuffer(offsets, wide)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[cuts[0]:cuts[-1]], cuts - cuts[0]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, which of them in that order are the first of their value, and one place of each value."""
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    return order, new, order[new]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keyed(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One key per (owner, word)."""
    return _mixed(words.view(np.uint64) + _mixed(owner.astype(np.uint64) + np.uint64(1)))


# --- claims and sentences in bytes -------------------------------------------------------

BREAK, SEMICOLON, POINT = 10, 59, 46
_WHITE, _STOPS = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[ord(c) for c in tx.WHITESPACE]] = True
_STOPS[[ord(c) for c in ".!?;"]] = True


class Texts:
    """The bytes of some texts, a line break after each, and the pieces between the claim breaks.

    White space is a break after one of ``.!?;`` or where it holds a line break; a semicolon before it goes with it.
    The pieces are stripped.  ``bare`` keeps every one of these characters, so a text and its bare form have their
    pieces in the same order.
    """

    def __init__(self, texts: pa.Array):
        data, cuts = _bytes(texts)
        ends = np.arange(len(cuts))
        self.data, self.cuts = np.insert(data, cuts[1:], BREAK), cuts + ends
        white = _WHITE[self.data]
        edges = np.flatnonzero(np.diff(white, prepend=False, append=False))
        self.opens, self.closes = edges[::2], edges[1::2]  # runs of white space
        last = self._run(self.cuts[1:] - 1)
        before = np.where(self.opens > 0, self.data[self.opens - 1], BREAK) if len(self.opens) else self.opens
        cut = _STOPS[before] | (before == BREAK)
        cut[self._run(np.flatnonzero(self.data == BREAK))] = True
        dropped = before == SEMICOLON
        dropped[last] = False  # at the end of a text there was no white space after it
        self.starts = np.concatenate([[0], self.closes[cut]])[:int(cut.sum())]
        self.ends = (self.opens - dropped)[cut]
        open_ = np.flatnonzero(dropped[cut] & (self.ends > self.starts))
        open_ = open_[white[self.ends[open_] - 1]]
        self.ends[open_] = self.opens[self._run(self.ends[open_] - 1)]
        # whole texts, stripped
        self.first, self.last = self.cuts[:-1].copy(), np.maximum(self.cuts[:-1], self.opens[last])
        led = np.flatnonzero(white[self.first])
        self.first[led] = np.minimum(self.last[led], self.closes[self._run(self.first[led])])
        self.last = np.maximum(self.first, self.last)

    def _run(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.opens, at, "right") - 1

    def lengths(self) -> np.ndarray:
        """Characters of the pieces."""
        return characters(self.data, self.starts, self.ends)

    def kept(self, pieces: np.ndarray, or_whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where these pieces begin and end, and those of whole texts."""
        starts, ends = self.starts[pieces], self.ends[pieces]
        if or_whole is not None and len(or_whole):
            starts = np.concatenate([starts, self.first[or_whole]])
            ends = np.concatenate([ends, self.last[or_whole]])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        return starts, ends

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, starts, "right") - 1

    def take(self, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> pa.Array:
        """The chosen ones of these parts; null for -1."""
        if not len(starts):
            return pa.nulls(len(chosen), pa.string())
        edges = np.column_stack([starts, ends]).ravel().astype(np.int32)  # parts and the gaps between them
        parts = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        return parts.take(pa.array(chosen * 2, pa.int64(), mask=chosen < 0))


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    if len(data) and data.max() > 127:
        later = np.zeros(len(data) + 1, np.int32)  # bytes that go on with a character
        np.cumsum(data & 0xC0 == 0x80, out=later[1:])
        length = length - (later[ends] - later[starts])
    return length


# --- words in bytes -------------------------------------------------------------------

LETTER, DIGIT, OTHER = 1, 2, 3  # a to z, 0 to 9, whatever else is in words
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[48:58], _KIND[95], _KIND[128:] = LETTER, DIGIT, OTHER, OTHER
_WIDTH = np.repeat([1, 2, 3, 4], [192, 32, 16, 16])  # bytes of the character that begins with a byte
_BASE = 0x9E3779B97F4A7C15
_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def bare(text: Column | str) -> Column:
    """Lower case, with a mark for the characters beyond ASCII that are in no word."""
    return F.regexp_replace(F.lower(tx.text_of(text)), terms.NOT_IN_WORDS, "|")


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, kept for blocks of the usual size."""
    size = max(n, 2 * BYTES_AT_ONCE)
    found = _POWERS.get(size)
    if found is None:
        found = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p, dtype=np.uint64))
        if size == 2 * BYTES_AT_ONCE:
            _POWERS[size] = found
    return found


class Words:
    """Hashes of the words in ``bare`` bytes: a polynomial over byte values modulo 2**64, mixed.

    The last byte is in no word.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        kind = _KIND[data]
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        edges = np.concatenate([[0], turns, [len(kind)]]) if len(kind) else np.zeros(1, np.int64)
        self.starts, self.ends = edges[:-1], edges[1:]  # runs of bytes of one kind
        self.kind = kind[self.starts]
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:len(data)], out=self.sums[1:])

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts]).view(np.int64)

    def _inside(self, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray):
        """How many words lie in each part, and the bounds of those that do."""
        a, z = np.searchsorted(starts, low), np.searchsorted(starts, high)
        turn = np.bincount(a, minlength=len(starts) + 1) - np.bincount(z, minlength=len(starts) + 1)
        inside = np.cumsum(turn)[:len(starts)] > 0
        return z - a, starts[inside], ends[inside]

    def tokens(self, strict_terms: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of three or more letters (or of any length) and numbers: how many in each part, and their hashes."""
        at = np.flatnonzero(self.kind == DIGIT)
        # a number takes one point with it: runs joined by points are paired from the first one on
        joined = (self.starts[at[1:]] == self.ends[at[:-1]] + 1) & (self.data[self.ends[at[:-1]]] == POINT)
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined])[:len(at)], place, 0))
        opens = (place - first) % 2 == 0
        ends = self.ends.copy()
        whole = np.flatnonzero(opens[:-1] & joined)
        ends[at[whole]] = self.ends[at[whole + 1]]
        taken = (self.kind == LETTER) & (self.ends - self.starts >= (3 if strict_terms else 1))
        taken[at[opens]] = True
        sizes, starts, ends = self._inside(self.starts[taken], ends[taken], low, high)
        number = (_KIND[self.data[starts]] == DIGIT).astype(np.int64)
        return sizes, self.hashed(starts, ends) & ~NUMBER | number

    def words(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of two or more letters: how many in each part, and their hashes in order."""
        inside = self.kind > 0
        before = np.concatenate([[False], inside[:-1]])[:len(inside)]
        starts, ends = self.starts[inside & ~before], self.starts[~inside & before]
        kept = ends - starts > _WIDTH[self.data[starts]]
        sizes, starts, ends = self._inside(starts[kept], ends[kept], low, high)
        return sizes, self.hashed(starts, ends)


def word_hashes(listed, flagged: bool) -> np.ndarray:
    """The same hashes for a word list."""
    listed = list(listed)
    data, cuts = _bytes(pa.array(listed, pa.string()))
    hashes = Words(data).hashed(cuts[:-1], cuts[1:]) if len(data) else np.zeros(len(listed), np.int64)
    if flagged:
        hashes = hashes & ~NUMBER | np.array([w[:1].isascii() and w[:1].isdigit() for w in listed], np.int64)
    return hashes


# --- lexical support --------------------------------------------------------------

def lexical_support(claim_record: np.ndarray, claim_sizes: np.ndarray, claim_tokens: np.ndarray,
                    evidence_sizes: np.ndarray, evidence_tokens: np.ndarray,
                    lists: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Supports of all claims of some records.

    ``lists`` has the hashes of the dropped words and of the term lists.  A token counts once in its claim.
    """
    n_claims, n_records = len(claim_sizes), len(evidence_sizes)
    record = np.repeat(np.arange(n_records), evidence_sizes)
    kept = ~np.isin(evidence_tokens, lists["dropped"])
    index = np.sort(_keyed(evidence_tokens[kept], record[kept]))
    claim = np.repeat(np.arange(n_claims), claim_sizes)
    kept = ~np.isin(claim_tokens, lists["dropped"])
    own, claim = claim_tokens[kept], claim[kept]
    _, _, first = _distinct(_keyed(own, claim))
    own, claim = own[first], claim[first]
    key = _keyed(own, claim_record[claim])
    at = np.searchsorted(index, key)
    found = np.zeros(len(key), bool)
    inside = at < len(index)
    found[inside] = index[at[inside]] == key[inside]
    count = lambda mask: np.bincount(claim[mask], minlength=n_claims)

    def share(of: np.ndarray, empty: float) -> np.ndarray:
        size, hits = count(of), count(of & found)
        return np.where(size == 0, empty, hits / np.maximum(size, 1))

    out = {"claim_token_support": share(np.ones(len(own), bool), 0.0)}
    # a claim without such terms is aligned; evidence without them has none of the claim's
    for column, name in (("clinical_direction_support", "direction"), ("negation_support", "negation"),
                         ("uncertainty_support", "uncertainty")):
        out[column] = share(np.isin(own, lists[name]), 1.0)
    out["numeric_support"] = share(own & NUMBER == 1, 1.0)
    out["high_impact_claim"] = count(np.isin(own, lists["high_impact"])) > 0
    return out


# --- best sentence by TF-IDF --------------------------------------------------------

def _grams(sizes: np.ndarray, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the kept words and of the pairs of neighbours among them."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kept = ~np.isin(words, stop)
    owner, words = owner[kept], words[kept]
    paired = owner[1:] == owner[:-1]
    pairs = _mixed(_mixed(words[:-1].view(np.uint64)) + words[1:].view(np.uint64))[paired].view(np.int64)
    return np.concatenate([owner, owner[1:][paired]]), np.concatenate([words, pairs])


def _counted(owner: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and frequency of the distinct (owner, term), in that order."""
    key, times = np.unique(owner * width + term, return_counts=True)
    return key // width, key % width, times


def best_sentences(claim_record: np.ndarray, claim_sizes: np.ndarray, claim_words: np.ndarray,
                   sentence_record: np.ndarray, sentence_sizes: np.ndarray, sentence_words: np.ndarray,
                   n_records: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best (cosine, sentence) of every claim among the sentences of its record; -1 where it has none.

    The idf of a claim's model is fitted on {claim} + sentences.  Only terms shared with the claim depend on
    the claim, so a sentence norm is a base norm plus a correction over the shared terms.
    """
    n_claims, n_sentences = len(claim_sizes), len(sentence_sizes)
    c_owner, c_word = _grams(claim_sizes, claim_words, stop)
    s_owner, s_word = _grams(sentence_sizes, sentence_words, stop)
    record = np.concatenate([claim_record[c_owner], sentence_record[s_owner]])
    order, new, first = _distinct(_keyed(np.concatenate([c_word, s_word]), record))
    term = np.empty(len(order), np.int64)
    term[order] = np.cumsum(new) - 1
    width = max(1, len(first))
    s_term, s_at, s_tf = _counted(term[len(c_word):], s_owner, max(1, n_sentences))  # by term, then sentence
    c_at, c_term, c_tf = _counted(c_owner, term[:len(c_word)], width)
    of_record = np.bincount(sentence_record, minlength=n_records)
    documents = 2.0 + of_record[record[first]]
    frequency = np.bincount(s_term, minlength=len(first))
    start = np.cumsum(frequency) - frequency
    idf = np.log(documents / (2.0 + frequency)) + 1.0
    idf_without = np.log(documents / (1.0 + frequency)) + 1.0
    change = idf ** 2 - idf_without ** 2
    base = np.bincount(s_at, (s_tf * idf_without[s_term]) ** 2, n_sentences)
    own = np.bincount(c_at, (c_tf * idf[c_term]) ** 2, n_claims)
    wide = of_record[claim_record]
    opening = (np.cumsum(of_record) - of_record)[claim_record]  # first sentence of the claim's record
    score, best = np.zeros(n_claims), np.where(wide > 0, opening, -1)
    postings = np.bincount(c_at, frequency[c_term], n_claims).astype(np.int64)
    spent = np.cumsum(wide + postings) // CELLS_AT_ONCE
    edges = np.concatenate([[0], np.flatnonzero(np.diff(spent)) + 1, [n_claims]])
    for low, high in zip(edges[:-1], edges[1:]):
        lo, hi = np.searchsorted(c_at, [low, high])
        cells = wide[low:high]
        total = int(cells.sum())
        if not total:
            continue
        place = np.cumsum(cells) - cells
        hits = frequency[c_term[lo:hi]]
        claim, t = c_at[lo:hi], c_term[lo:hi]
        posting = np.repeat(start[t] - (np.cumsum(hits) - hits), hits)
        posting += np.arange(len(posting))
        cell = np.repeat(place[claim - low] - opening[claim], hits)
        cell += s_at[posting]
        times = s_tf[posting].astype(float)
        product = np.bincount(cell, np.repeat(c_tf[lo:hi] * idf[t] ** 2, hits) * times, total)
        correction = np.bincount(cell, np.repeat(change[t], hits) * times * times, total)
        owner = np.repeat(np.arange(low, high), cells)
        there = opening[owner] + np.arange(total) - np.repeat(place, cells)
        scale = np.sqrt(own[owner]) * np.sqrt(np.maximum(base[there] + correction, 0.0))
        cosine = np.divide(product, scale, out=np.zeros(total), where=scale > 0)
        # equal sentences may differ in the last bit; after rounding the first one wins
        shown = np.round(cosine, 12)
        filled = np.flatnonzero(cells)
        most = np.maximum.reduceat(shown, place[filled])
        equal = np.flatnonzero(shown == np.repeat(most, cells[filled]))
        _, top = np.unique(owner[equal], return_index=True)
        score[low + filled] = cosine[equal[top]]
        best[low + filled] = there[equal[top]]
    return score, best


# --- the Arrow step ---------------------------------------------------------------------

def _blocks(batch: pa.RecordBatch, counted: list[str]) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``BYTES_AT_ONCE`` bytes of text."""
    size = sum(np.diff(_bytes(batch.column(name))[1]) for name in counted)
    total, first = np.cumsum(size + 1), 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + BYTES_AT_ONCE, "right")))
        yield batch.slice(first, last - first)
        first = last


def _score_batch(block: pa.RecordBatch, keep: list[str], known: dict[str, np.ndarray] | None,
                 stop: np.ndarray | None, strict_terms: bool = True) -> pa.RecordBatch:
    """The claims of whole records with their lexical supports (``known`` words) and best sentences (``stop`` words)."""
    answers, bare_answers = Texts(block.column("_answer")), Texts(block.column("_ab"))
    claims = np.flatnonzero(answers.lengths() >= tx.CLAIM_LENGTH)
    record = answers.owner(answers.starts[claims])
    sizes = np.bincount(record, minlength=block.num_rows)
    out = {"claim_text": answers.take(*answers.kept(claims), np.arange(len(claims)))}
    own, evidence = Words(bare_answers.data), Texts(block.column("_kb"))
    parts, others = bare_answers.kept(claims), Words(evidence.data)
    if known is not None:
        found = lexical_support(record, *own.tokens(strict_terms, *parts),
                                *others.tokens(strict_terms, evidence.cuts[:-1], evidence.cuts[1:]), known)
        out |= {c: pa.array(found[c]) for c in LEXICAL}
    if stop is not None:
        knowledge = Texts(block.column("_knowledge"))
        long = np.flatnonzero(knowledge.lengths() >= tx.SENTENCE_LENGTH)
        # a text without a long sentence is kept whole
        alone = np.ones(block.num_rows, bool)
        alone[knowledge.owner(knowledge.starts[long])] = False
        alone = np.flatnonzero(alone & (knowledge.last > knowledge.first))
        sentences = knowledge.kept(long, alone)
        score, best = best_sentences(record, *own.words(*parts), knowledge.owner(sentences[0]),
                                     *others.words(*evidence.kept(long, alone)), block.num_rows, stop)
        chosen = knowledge.take(*sentences, best)
        out |= dict(zip(SEMANTIC, (pa.array(score), chosen.fill_null("")), strict=True))
    rows = pa.StructArray.from_arrays(list(out.values()), list(out))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], pa.ListArray.from_arrays(offsets, rows)],
                                      [*keep, "_c"])


def claim_rows(df: DataFrame, keep: list[str], answer: str = "answer", knowledge: str = "knowledge",
               lists=None, stopwords: list[str] | None = None) -> DataFrame:
    """One row per claim: ``keep``, ``claim_index`` (from 1), ``claim_text`` and its supports.

    ``lists`` (term lists) adds the lexical supports, ``stopwords`` the TF-IDF score and best sentence.  A record
    without claims has one row with a null claim.
    """
    texts, known, stop, strict_terms = ["_answer", "_ab", "_kb"], None, None, True
    prepared = df.select(*keep, tx.text_of(answer).alias("_answer"), bare(answer).alias("_ab"),
                         tx.text_of(knowledge).alias("_knowledge"), bare(knowledge).alias("_kb"))
    if lists is not None:
        negation, strict_terms = set(lists.negation), lists.strict_terms
        known = {name: word_hashes(words, True) for name, words in {
            "dropped": [w for w in lists.stopwords if w not in negation], "direction": lists.direction,
            "negation": lists.negation, "uncertainty": lists.uncertainty, "high_impact": lists.high_impact}.items()}
    if stopwords is not None:
        texts.append("_knowledge")
        stop = word_hashes(stopwords, False)
    names = (LEXICAL if lists is not None else []) + (SEMANTIC if stopwords is not None else [])
    kinds = {"high_impact_claim": "boolean", "best_evidence_sentence": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, texts):
                yield _score_batch(block, keep, known, stop, strict_terms)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.select(*keep).schema)
    inner = ", ".join(f"{c}: {kinds.get(c, 'double')}" for c in names)
    rows = prepared.select(*keep, *texts).mapInArrow(
        run, f"{shape}, _c array<struct<claim_text: string{', ' if names else ''}{inner}>>")
    return rows.select(*keep, F.posexplode_outer("_c").alias("_pos", "_c")).select(
        *keep, (F.col("_pos") + 1).alias("claim_index"), "_c.*")
