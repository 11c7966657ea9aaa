"""Secrets by a linear-chain conditional random field beside fixed patterns.

Tokens are runs of letters, digits and ``+ / _ . -``.  Each is tagged as begin of a secret, inside or
outside, from its shape, the words before and after it, the characters between them and features of
the whole text.  The field is trained by gradient ascent on its log-likelihood (forward-backward) on
a bounded sample of texts.  Their tags are the spans of the fixed patterns and secrets planted for training,
which the patterns cannot explain: random values behind made-up key names or in plain words.  Planted
beside them are harmless strings of digits and letters (times, versions, addresses, numbers), which stay
outside.  In half of the windows the words and marks around secrets are hidden, so that the field also
learns to go by the value.  Decoding is exact
Viterbi: a token whose outside score leads by more than transitions could win back is outside in the
best path, so paths are computed over the stretches between such tokens only.  Spans of the patterns
always stay; the field adds those that overlap none of them.

Nulls and edges: null and empty texts have no spans; a text may be of any length and is read whole;
without training rows only the patterns count; repeated rows and extra columns change nothing; ties
between paths go to the tag listed first (outside, begin, inside).
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words

SAMPLE = 600  # texts with and without pattern spans, each
WINDOWS = 4  # training windows around pattern spans, and around planted strings, of one text
LONGEST = 1 << 20  # bytes of a training text; longer ones are scanned, not learnt from
CONTEXT = 12
STEPS = 80
O, B, I = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")
# fixed values: the patterns of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINT = re.compile(rb"(?i)passw|secret|token|api_?key")
HEX_HINT = re.compile(rb"[0-9a-f]{32}")


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, in code points."""
    out = []
    if HINT.search(data):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if HEX_HINT.search(data):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _mask(chars: bytes, high: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    if high:
        out[128:] = True
    return out


_DIGIT = _mask(b"0123456789")
_UPPER = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEXADECIMAL = _mask(b"abcdef")
_LOWER = _mask(b"abcdefghijklmnopqrstuvwxyz", high=True)
_TOKEN = _DIGIT | _UPPER | _LOWER | _mask(b"+/_.-")
_SETS, _QUOTE, _LINE = _mask(b"=:"), _mask(b"\"'`"), _mask(b"\n\r")
HASHED = 1 << 12
SHAPES, GAPS, FILES = 8 * 6 * 4 * 2, 8, 16
WIDTHS = (SHAPES, HASHED, HASHED, GAPS * SHAPES, GAPS * 2, FILES * 2)
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])


def tokens_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.diff(np.concatenate([[0], _TOKEN[data].astype(np.int8), [0]]))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def features(data: np.ndarray, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends and feature numbers (one row per token).

    ``hidden`` marks tokens whose neighbouring words and gap characters are left out.
    """
    starts, ends = tokens_of(data)
    if not len(starts):
        return starts, ends, np.zeros((0, len(WIDTHS)), np.int32)

    def inside(table):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total

    digits, upper, lower, hexes = (t[ends] - t[starts] for t in map(inside, (_DIGIT, _UPPER, _LOWER, _HEXADECIMAL)))
    size = ends - starts
    length = np.digitize(size, [4, 8, 12, 16, 20, 32, 40])
    share = np.where(digits == 0, 0, 1 + np.minimum(4, digits * 5 // size))
    case = (upper > 0) * 2 + (lower > 0)
    only_hex = (upper == 0) & (lower == hexes) & (digits + hexes == size) & (digits > 0)
    shape = ((length * 6 + share) * 4 + case) * 2 + only_hex
    # short words by their letters, long ones alike
    word = (words.hash_words(data, starts, np.minimum(ends, starts + 24), True) >> np.uint64(52)).astype(np.int32)
    before, after = np.concatenate([[0], word[:-1]]), np.concatenate([word[1:], [0]])
    left = np.concatenate([[0], ends[:-1]])
    gap = np.zeros(len(starts), np.int64)
    for bit, table in enumerate((_SETS, _QUOTE, _LINE)):
        total = inside(table)
        gap += (total[starts] > total[left]) << bit
    if hidden is not None:
        before, after, gap = (np.where(hidden, 0, x) for x in (before, after, gap))
    strange = (share > 0) & (length >= 3)
    dense = int(min(3, strange.sum()))
    lines = int(min(3, np.log10(1 + _LINE[data].sum())))
    file = np.full(len(starts), dense * 4 + lines)
    codes = (shape, before, after, gap * SHAPES + shape, gap * 2 + strange, file * 2 + strange)
    return starts, ends, np.stack(codes, axis=1).astype(np.int32) + OFFSETS[:-1].astype(np.int32)


def forward_backward(score: np.ndarray, move: np.ndarray, used: np.ndarray):
    """Tag and transition expectations of padded sequences ``score[n, t, tag]``; ``used`` marks tokens."""
    n, length, tags = score.shape
    logsum = lambda x, axis: x.max(axis, keepdims=True) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis, keepdims=True))
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0] + move[O]  # a window begins after an outside token
    for t in range(1, length):
        step = logsum(alpha[:, t - 1, :, None] + move, 1)[:, 0] + score[:, t]
        alpha[:, t] = np.where(used[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = logsum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)[:, :, 0]
        beta[:, t] = np.where(used[:, t + 1, None], step, beta[:, t + 1])
    total = logsum(alpha[:, -1], 1)
    tag = np.exp(alpha + beta - total[:, None]) * used[:, :, None]
    pair = alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, :, None, None]
    return tag, (np.exp(pair) * used[:, 1:, None, None]).sum((0, 1))


def fit(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (feature, tag) and transition weights from (features, tags) windows."""
    length = max(len(t) for _, t in windows)
    n, width = len(windows), len(WIDTHS)
    codes, gold, used = np.zeros((n, length, width), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (f, t) in enumerate(windows):
        codes[i, :len(t)], gold[i, :len(t)], used[i, :len(t)] = f, t, True
    weights, move = np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3))
    onehot = np.eye(3)[gold] * used[:, :, None]
    seen = np.zeros((3, 3))
    both = used[:, 1:]
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    first = np.bincount(gold[:, 0], minlength=3)
    power, move_power = np.full_like(weights, 1e-2), np.full_like(move, 1e-2)
    flat = codes[used]
    for _ in range(STEPS):
        score = weights[codes].sum(2)
        tag, pair = forward_backward(score, move, used)
        change = (onehot - tag)[used]
        grad = -1e-2 * weights
        for k in range(width):
            for c in range(3):
                grad[:, c] += np.bincount(flat[:, k], change[:, c], len(weights))
        step = seen - pair - 1e-2 * move
        step[O] += first - tag[:, 0].sum(0)
        power += grad * grad
        move_power += step * step
        weights += 0.4 * grad / np.sqrt(power)
        move = np.clip(move + 0.2 * step / np.sqrt(move_power), -4, 4)
    return weights, move


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of a sequence that stands between outside tokens."""
    best, back = score[0] + move[O], []
    for row in score[1:]:
        paths = best[:, None] + move
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tags = [int((best + move[:, O]).argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return np.array(tags[::-1])


def decode(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Viterbi tags of a whole text; see the module text for why stretches suffice."""
    tags = np.zeros(len(score), np.int8)
    open_ = score[:, O] - score[:, 1:].max(1) <= 2 * (move.max() - move.min())
    edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        if (score[a:z, 1:].max(1) - score[a:z, O] + 2 * (move.max() - move.min())).sum() > 0:
            tags[a:z] = viterbi(score[a:z], move)
    return tags


def _code_points(data: bytes, at: list[int]) -> list[int]:
    """Code point offsets of ascending byte offsets."""
    out, last, total = [], 0, 0
    for x in at:
        total += len(data[last:x].decode("utf-8", "replace"))
        out.append(total)
        last = x
    return out


def field_spans(data: bytes, model) -> list[tuple[int, int]]:
    weights, move = model
    array = np.frombuffer(data, np.uint8)
    starts, ends, codes = features(array)
    if not len(starts):
        return []
    score = np.zeros((len(starts), 3), np.float32)
    for k in range(codes.shape[1]):
        score += weights[codes[:, k]]
    tags = decode(score, move)
    marked = np.flatnonzero(tags)
    if not len(marked):
        return []
    begin = marked[(tags[marked] == B) | (tags[np.maximum(marked - 1, 0)] == O) | (marked == 0)]
    stop = np.concatenate([begin[1:], [len(tags)]])
    last = [int(b + 1 + np.argmin(np.append(tags[b + 1:s] == I, False))) - 1 for b, s in zip(begin, stop, strict=True)]
    bounds = [x for b, e in zip(begin, last, strict=True) for x in (int(starts[b]), int(ends[e]))]
    points = _code_points(data, bounds)
    return list(zip(points[::2], points[1::2], strict=True))


def spans_of(data: bytes | None, model) -> list[tuple[int, int, int]]:
    """All spans of a text: the patterns' and those the field adds."""
    if not data:
        return []
    text = data.decode("utf-8", "replace")
    base = base_spans(text, data)
    if model is None:
        return base
    extra = [(a, z, 3) for a, z in field_spans(data, model) if not any(a < e and s < z for s, e, _ in base)]
    return sorted(base + extra, key=lambda s: (s[0], s[2], s[1]))


_SYLLABLES = "ba co di fu ge hi jo ka lu me no pi qua re su ta vi wo xe zy".split()
_LOWER_CASE, _CAPITALS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _word(r: random.Random, least: int = 2, most: int = 4) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(least, most)))


def planted_secret(r: random.Random) -> tuple[str, str]:
    """What stands before a made-up secret, and its value."""
    alphabet = r.choice([_LOWER_CASE + _CAPITALS + _DIGITS, _LOWER_CASE + _CAPITALS + _DIGITS, _CAPITALS + _DIGITS,
                         _LOWER_CASE + _DIGITS, "abcdef" + _DIGITS, _LOWER_CASE + _CAPITALS + _DIGITS + "+/_-"])
    size = r.choice([12, 16, 20, 24, 28, 30, 31, 36, 40])
    value = "".join(r.choice(alphabet) for _ in range(min(size, 31) if "g" not in alphabet.lower() else size))
    mixed = [r.choice(_DIGITS), r.choice(alphabet), r.choice(_DIGITS)]
    value = value[:3] + "".join(mixed) + value[6:]
    if r.random() < 0.15:
        value = r.choice(["sk", "pk", "ghx", "xob", "AIz"]) + r.choice("-_") + value
    name = r.choice([_word(r), f"{_word(r, 1, 2)}_{r.choice(['key', 'pin', 'code', 'id'])}", _word(r).upper(),
                     f"{_word(r, 1, 2)}-{_word(r, 1, 2)}", "the " + _word(r), f"{_word(r, 1, 2)} {_word(r, 1, 2)}"])
    return name + r.choice(["=", ": ", " = ", "='", ': "', " is ", " ", " -> ", ":"]), value


def planted_harmless(r: random.Random) -> str:
    """A string of digits and letters that is no secret."""
    number = lambda n: "".join(r.choice(_DIGITS) for _ in range(n))
    return r.choice([
        lambda: f"20{number(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}:{number(2)}:{number(2)}Z",
        lambda: f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{r.choice(['beta', 'rc1', 'final'])}",
        lambda: f"+{r.randint(1, 99)} {number(3)} {number(7)}", lambda: number(r.randint(3, 16)),
        lambda: f"https://{_word(r)}.{r.choice(['org', 'com', 'net'])}/{_word(r)}/{_word(r)}_{number(4)}.html",
        lambda: f"{_word(r)}{number(r.randint(1, 4))}@{_word(r)}.com", lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f"/usr/{_word(r)}/{_word(r)}-{number(1)}.{number(1)}/{_word(r)}.py", lambda: f"{_word(r).title()}{_word(r).title()}",
        lambda: f"{_word(r)}-{_word(r)}-{_word(r)}_{_word(r)}", lambda: f"{r.randint(1, 9999)},{number(3)}.{number(2)}",
        lambda: f"{_word(r).upper()}-{number(2)}", lambda: f"{number(1)}{r.choice(['st', 'nd', 'th', 'kg', 'MB', 'am'])}",
        lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: f"{number(3)}.{number(2)}.{number(1)}.{number(2)}",
        lambda: f"{_word(r)}_{_word(r)}_{_word(r)}({_word(r)})"])()


def with_planted(text: str, r: random.Random) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The text with planted strings between words, the spans of the secrets, and where the harmless ones begin."""
    gaps = [m.end() for m in re.finditer(r"\s+", text)] or [len(text)]
    kinds = [True] * r.randint(0, WINDOWS // 2 + 1) + [False] * r.randint(0, WINDOWS)
    places = sorted((r.choice(gaps), r.random(), k) for k in kinds)
    out, at, secrets, harmless = [], 0, [], []
    size = 0
    for place, _, secret in places:
        out.append(text[at:place])
        size += place - at
        at = place
        before, value = planted_secret(r) if secret else ("", planted_harmless(r))
        closing = {"'": "'", '"': '"'}.get(before[-1:], "")
        (secrets.append((size + len(before), size + len(before) + len(value))) if secret else harmless.append(size))
        piece = f"{before}{value}{closing}" + r.choice([" ", "\n", ". ", ", "])
        out.append(piece)
        size += len(piece)
    return "".join(out) + text[at:], secrets, harmless


def training_windows(data: bytes, number: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows around secrets and harmless strings, and one elsewhere; odd windows hide what stands around."""
    if len(data) > LONGEST:
        return []
    r = random.Random(number)
    text, secrets, harmless = with_planted(data.decode("utf-8", "replace"), r)
    data = text.encode("utf-8", "replace")
    array = np.frombuffer(data, np.uint8)
    starts, ends = tokens_of(array)
    if not len(starts):
        return []
    tags = np.zeros(len(starts), np.int64)
    known = []
    for a, z, kind in base_spans(text, data):
        if kind == 0:
            m = ASSIGN.match(text, a)
            a, z = m.start(2), m.end(2)
        known.append((a, z))
    r.shuffle(known)
    offsets = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "replace")) for c in text])])
    marks = []
    for a, z in known + secrets:
        mine = np.flatnonzero((starts < offsets[z]) & (ends > offsets[a]))
        tags[mine] = I
        tags[mine[:1]] = B
        marks.append(int(mine[0]) if len(mine) else 0)
    chosen = marks[:WINDOWS] + marks[len(known):]
    chosen += [int(np.searchsorted(ends, offsets[a], "right").clip(0, len(tags) - 1)) for a in harmless]
    out, plain = [], None
    for k, at in enumerate([*chosen, r.randrange(len(tags))]):
        if (number + k) % 2:
            hidden = np.zeros(len(tags), bool)
            hidden[at] = True
            _, _, codes = features(array, hidden)
        else:
            if plain is None:
                _, _, plain = features(array)
            codes = plain
        part = slice(max(0, at - CONTEXT), at + CONTEXT)
        out.append((codes[part], tags[part]))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """The field, fitted in one task on the windows of about ``sample`` texts with pattern spans and as many of all.

    The texts are drawn by a hash of id and text in the tasks that read them; only their windows leave those.
    """
    pattern = "(?i)(passw(or)?d|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(key.alias("h"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    source = source.withColumn("marked", F.col("text").rlike(pattern))
    counts = source.agg(F.count("*").alias("all"), F.count_if("marked").alias("marked")).first()
    slots = 1 << 30
    part = lambda rows: int(slots * min(1.0, sample / max(1, rows)))
    place = F.pmod("h", F.lit(slots))
    drawn = source.filter((place < part(counts["all"])) | (F.col("marked") & (place < part(counts["marked"])))).select(
        "h", F.col("text").cast("binary").alias("text"))

    def cut(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                out = [(h, k, f.tobytes(), t.tobytes())
                       for h, text in zip(batch.column("h").to_pylist(), words.as_bytes(batch.column("text")), strict=True)
                       for k, (f, t) in enumerate(training_windows(text, h & 0x7FFFFFFF))]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["h", "k", "codes", "tags"])

    def run(batches):
        rows = sorted({tuple(r.values()) for b in batches for r in b.to_pylist()})
        windows = [(np.frombuffer(f, np.int32).reshape(-1, len(WIDTHS)), np.frombuffer(t, np.int64)) for _, _, f, t in rows]
        if windows:
            weights, move = fit(windows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([move.astype("<f8").tobytes()], pa.binary())],
                ["weights", "move"])

    windows = drawn.mapInArrow(cut, "h long, k int, codes binary, tags binary")
    model = windows.repartition(1).mapInArrow(run, "weights binary, move binary").first()
    if model is None:
        return None
    return (np.frombuffer(model["weights"], "<f4").reshape(-1, 3), np.frombuffer(model["move"], "<f8").reshape(3, 3))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


def scan(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts per pattern, ``base_sha256`` and ``spans`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, "text"):
                out = []
                for t in words.as_bytes(batch.column("text")):
                    found = spans_of(t, shared.value)
                    base = [s for s in found if s[2] < 3]
                    counts = [sum(s[2] == k for s in base) for k in range(3)]
                    out.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(found)))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns],
                                                 ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                  "spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``n_chars``, if there, is set anew where that happens."""
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(data: bytes | None) -> tuple[str | None, int | None]:
        found = spans_of(data, shared.value)
        if not found:
            return None, None
        text, parts, at = data.decode("utf-8", "replace"), [], 0
        for a, z, _ in found:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, z)
        new = "".join(parts) + text[at:]
        return new, len(new)

    def run(batches):
        for whole in batches:
            for batch in words.row_blocks(whole, text_col):
                new = [clean(t) for t in words.as_bytes(batch.column(text_col))]
                fresh = {text_col: pa.array([n for n, _ in new], pa.string())}
                if "n_chars" in columns:
                    fresh["n_chars"] = pa.array([n for _, n in new], pa.int64()).cast(batch.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(
                    [pa.compute.coalesce(fresh[c], batch.column(c)) if c in fresh else batch.column(c)
                     for c in columns], columns)

    return docs.mapInArrow(run, docs.schema)
