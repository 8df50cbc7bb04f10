"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the tokens of a line as B (a secret begins), I (it goes on) or O. Tokens are runs of the characters that
secrets are written in; their features are shape (length, kinds of characters and changes between them), neighbouring
words (names like password, signs like = and quotes before the token) and file features (of the whole text). It is
trained here: on lines of a bounded sample of documents, labelled by the patterns, some of which get generated secrets
put in, and others what looks like one and isn't (addresses, paths, versions, digests of files, names in code). Decoding is Viterbi, and exact: a line is skipped only if an upper bound shows that no path beats all-O.

Spans count code points, the end is exclusive. Spans that the field finds are added unless they overlap a pattern's.

Edge cases: null and empty texts have no spans; texts and lines may have any length; repeated rows get equal spans;
extra columns are ignored; if the table has no text, the field learns from generated lines alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.tokens import free_memory, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
ADDED = "crf"
NAMES = re.compile(rb"passw|passphrase|pwd|secret|token|api_?key|auth|bearer|credential|private|access_?key")
#: Endings of file and host names.
ENDINGS = re.compile(rb"\.(?:com|org|net|edu|gov|io|dev|html?|php|js|css|json|ya?ml|xml|txt|csv|md|py|java|cpp?|go|rs|png|jpe?g|gif|svg|pdf|zip|gz|tar|exe|log)\b")

O, B, I = 0, 1, 2
N_FEATURES = 36
BLOCKED = -1e4


@dataclass(frozen=True)
class Options:
    """The field learns from lines of ``sample_docs`` whole texts at most, from ``generated`` lines with a secret and from
    as many without."""

    sample_docs: int = 300
    generated: int = 500
    steps: int = 100
    seed: int = 5


def base_spans(text: str) -> list[tuple[int, int, str, tuple[int, int]]]:
    """(start, end, kind, secret itself) of the patterns, leftmost and not overlapping within a kind, ordered."""
    out = [(m.start(), m.end(), "assign", m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access", m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


# Byte classes: 1 digit, 2 upper, 3 lower, 4 sign within tokens; 0 ends a token.
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[[ord(c) for c in "+/_.=-"]] = 4
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


class Tokens:
    """Tokens of texts with features, in a buffer where a line end follows each text, so that nothing reaches over its
    end; ``bounds`` are the texts' offsets in the buffer."""

    def __init__(self, texts: list[bytes]) -> None:
        body = b"\n".join([*texts, b""])
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.body, self.bounds = body, bounds
        raw = np.frombuffer(body, np.uint8)
        kind = _CLASS[raw]
        inside = kind > 0
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.start, self.end = starts, ends
        n = len(starts)
        self.text = np.searchsorted(bounds, starts, side="right") - 1
        lines = np.flatnonzero(raw == 10)
        self.line = np.searchsorted(lines, starts)
        self.x = np.zeros((n, N_FEATURES), np.float32)
        if not n:
            self.named = np.zeros(0, bool)
            return

        def per_token(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
            return total[ends] - total[starts]

        size = (ends - starts).astype(np.int64)
        digits, upper, lower = (per_token(kind == k) for k in (1, 2, 3))
        signs, hexed = size - digits - upper - lower, per_token(_HEX[raw])
        change = np.zeros(len(raw), bool)
        change[1:] = (kind[1:] != kind[:-1]) & inside[1:] & inside[:-1]
        changes = per_token(change)
        dots, slashes = per_token(raw == 46), per_token(raw == 47)
        words = per_token(np.append((kind[1:] == 4) & (kind[:-1] == 3), False))  # small letters that a sign ends
        known = np.zeros(n, bool)
        ended = np.array([m.end() for m in ENDINGS.finditer(body)], np.int64)
        at = np.searchsorted(ends, ended)
        known[at[(at < n) & (ends[np.minimum(at, n - 1)] == ended)]] = True
        hits = np.array([m.start() for m in NAMES.finditer(body.lower())], np.int64)
        named = np.zeros(n, bool)
        own = np.searchsorted(starts, hits, side="right") - 1
        named[own[(own >= 0) & (hits < ends[np.maximum(own, 0)])]] = True
        self.named = named
        gap0 = np.concatenate([[0], ends[:-1]])
        between = lambda codes: self._between(np.isin(raw, [ord(c) for c in codes]), gap0, starts)
        same_line = lambda k: np.concatenate([np.zeros(k, bool), self.line[k:] == self.line[:-k]]) if n > k else np.zeros(n, bool)
        back = lambda a, k: np.concatenate([np.zeros(k, bool), a[:-k]])[:n] & same_line(k)
        letters = digits + signs == 0
        mixed = (digits > 0) & (upper + lower > 0)
        texts = len(bounds) - 1
        per_text = lambda flag: np.bincount(self.text, weights=flag, minlength=texts)
        count = np.maximum(1, np.bincount(self.text, minlength=texts))
        next_named = np.concatenate([named[1:], [False]]) & np.concatenate([same_line(1)[1:], [False]])
        for k, f in enumerate((
            np.ones(n), size < 8, (size >= 8) & (size < 16), (size >= 16) & (size < 32), size >= 32,  # shape
            letters, digits == size, hexed == size, mixed, mixed & (upper > 0) & (lower > 0), mixed & (size >= 16),
            changes >= 4, changes >= 8, changes * 4 >= size, signs >= 1, signs * 4 >= size, upper == size,
            mixed & (hexed == size) & (size >= 16),
            named, back(named, 1), back(named, 2), next_named, between("="), between(":"), between("\"'"),  # neighbours
            back(mixed & (size >= 8), 1) & (starts - gap0 == 1), between("@"), np.append(between("@")[1:], False),
            dots >= 1, dots * 8 >= size, slashes >= 2, back(slashes >= 1, 1) & between(":"), known, words >= 3,
            per_text(named)[self.text] > 0, per_text(mixed & (size >= 16))[self.text] * 20 > count[self.text],  # file
        )):
            self.x[:, k] = f

    @staticmethod
    def _between(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return total[b] - total[np.minimum(a, b)] > 0


@dataclass(frozen=True)
class Field:
    """Weights: ``emit`` (features x tags), ``move`` (tag to tag), ``enter`` and ``leave`` a line."""

    emit: np.ndarray
    move: np.ndarray
    enter: np.ndarray
    leave: np.ndarray

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        n = len(scores)
        best, back = self.enter + scores[0], np.zeros((n, 3), np.int8)
        for t in range(1, n):
            all_ = best[:, None] + self.move
            back[t] = all_.argmax(0)
            best = all_.max(0) + scores[t]
        tags = np.zeros(n, np.int8)
        tags[-1] = (best + self.leave).argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, scores: np.ndarray, line: np.ndarray) -> list[tuple[int, int]]:
        """(first token, end) of the secrets; ``line`` rises where a new chain starts."""
        if not len(scores):
            return []
        gain, move = scores - scores[:, [O]], self.move - self.move[O, O]
        out_of = max(move[B, O], move[I, O], (self.leave - self.leave[O])[1:].max())
        b = gain[:, B] + max(move[:, B].max(), (self.enter - self.enter[O])[B]) + out_of
        i = np.maximum(0, gain[:, I] + move[1:, I].max())
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        bound = np.maximum.reduceat(b, first) + np.add.reduceat(i, first)
        ends = np.append(first[1:], len(line))
        found = []
        for k in np.flatnonzero(bound > 0):
            tags = self.viterbi(scores[first[k] : ends[k]])
            for t in np.flatnonzero(tags == B):
                e = t + 1
                while e < len(tags) and tags[e] == I:
                    e += 1
                found.append((first[k] + t, first[k] + e))
        return found


def train(lines: list[tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam, all lines at once: forward-backward over positions, side by side over lines."""
    n, longest = len(lines), max(len(y) for _, y in lines)
    x, y, inside = np.zeros((n, longest, N_FEATURES), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (f, t) in enumerate(lines):
        x[k, : len(t)], y[k, : len(t)], inside[k, : len(t)] = f, t, True
    size = inside.sum(1)
    hot = np.eye(3)[y] * inside[:, :, None]
    steps_real = np.zeros((3, 3))
    np.add.at(steps_real, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    last = np.arange(n), size - 1
    flat = x.reshape(-1, N_FEATURES)

    def by_feature(tags: np.ndarray) -> np.ndarray:
        return (flat.T @ tags.reshape(-1, 3).astype(np.float32)).astype(np.float64)

    real = {"emit": by_feature(hot), "move": steps_real, "enter": hot[:, 0].sum(0), "leave": hot[last].sum(0)}
    w = {"emit": np.zeros((N_FEATURES, 3)), "move": np.zeros((3, 3)), "enter": np.zeros(3), "leave": np.zeros(3)}
    block_move, block_enter = np.zeros((3, 3)), np.zeros(3)
    block_move[O, I] = block_enter[I] = BLOCKED
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = (flat @ w["emit"].astype(np.float32)).reshape(n, longest, 3).astype(np.float64)
        move, enter = w["move"] + block_move, w["enter"] + block_enter
        alpha = np.zeros((n, longest, 3))
        alpha[:, 0] = enter + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
        beta = np.zeros((n, longest, 3))
        for t in range(longest - 1, -1, -1):
            ended = size == t + 1
            if t + 1 < longest:
                beta[:, t] = lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[ended, t] = w["leave"]
        z = lse(alpha[last] + w["leave"], 1)
        p = np.exp(np.minimum(0, alpha + beta - z[:, None, None])) * inside[:, :, None]
        joint = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        joint = np.exp(np.minimum(0, joint)) * inside[:, 1:, None, None]
        seen = {"emit": by_feature(p), "move": joint.sum((0, 1)), "enter": p[:, 0].sum(0), "leave": p[last].sum(0)}
        for k in w:
            g = (seen[k] - real[k]) / n + decay * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Field(w["emit"], w["move"] + block_move, w["enter"] + block_enter, w["leave"])


def _labelled(texts: list[str], marked: list[list[tuple[int, int]]], longest: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and tags by line; ``marked`` are the secrets of each text, in bytes. Long lines become several chains."""
    t = Tokens([t.encode() for t in texts])
    y = np.zeros(len(t.start), np.int64)
    for k, spans in enumerate(marked):
        for a, b in spans:
            own = np.flatnonzero((t.start < t.bounds[k] + b) & (t.end > t.bounds[k] + a))
            y[own], y[own[:1]] = I, B
    out = []
    for part in np.split(np.arange(len(y)), np.flatnonzero(np.diff(t.line)) + 1):
        out += [(t.x[part[s : s + longest]], y[part[s : s + longest]]) for s in range(0, len(part), longest)]
    return [(f, np.where((np.arange(len(v)) == 0) & (v == I), B, v)) for f, v in out if len(v)]


def _generated(rng: np.random.Generator, lines: list[str], n: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Lines with one generated secret, and where it is."""
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
    forms = ['{n} = "{s}"', "{n}: {s}", "{n}={s}", "{n} {s}", "'{n}': '{s}'", '"{n}" : "{s}"', "{n} is {s}"]
    names = ["password", "pwd", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "Authorization: Bearer", "credential", "private_key", "access_key", "passwd"]
    texts, spans = [], []
    for _ in range(n):
        letters = alphabets[rng.integers(3)]
        s = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(16, 64)))
        if rng.random() < 0.15:  # written in groups
            s = ":".join(s[i : i + 8] for i in range(0, len(s), 8))
        own = rng.random() < 0.4  # letters that say whose secret it is
        if own:
            s = "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 6))) + "_-"[rng.integers(2)] + s
        elif rng.random() < 0.15:
            s = ".".join(s[i : i + len(s) // 3 + 1] for i in range(0, len(s), len(s) // 3 + 1))
        bare = rng.random() < (0.5 if own else 0.2) and letters is alphabets[2]
        put = s if bare else forms[rng.integers(len(forms))].format(n=names[rng.integers(len(names))], s=s)
        line = lines[rng.integers(len(lines))] if lines and rng.random() < 0.7 else ""
        words = line.split(" ")
        at = int(rng.integers(0, len(words) + 1))
        text = " ".join([*words[:at], put, *words[at:]])
        first = len(text[: text.index(put) + put.index(s)].encode())
        texts.append(text)
        spans.append([(first, first + len(s))])
    return texts, spans


def _harmless(rng: np.random.Generator, lines: list[str], n: int) -> list[str]:
    """Lines with something that looks like a secret and isn't."""
    lower, hexed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    some = lambda letters, a, b: "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(a, b)))
    word, number = lambda: some(lower, 3, 11), lambda: int(rng.integers(0, 10 ** int(rng.integers(1, 7))))
    tops, files = ("com", "org", "net", "io"), ("html", "py", "json", "png", "log", "csv", "tar.gz")
    host = lambda: f"{word()}{number() % 100 if rng.random() < 0.5 else ''}.{word()}.{tops[rng.integers(4)]}"
    kinds = (
        lambda: f"{word()}.{word()}{number() % 100}@{host()}", lambda: f"{word()}{number()}@{host()}", lambda: host(),
        lambda: f"https://{host()}/{word()}/{number()}/{word()}-{word()}-{number()}.{files[rng.integers(7)]}?id={number()}",
        lambda: f"/usr/{word()}/{word()}_{number()}/{word()}.{files[rng.integers(7)]}",
        lambda: f"{word()}_{word()}_{number()}", lambda: "".join(word().title() for _ in range(rng.integers(2, 5))) + str(number() % 10), lambda: f"v{number() % 20}.{number() % 30}.{number() % 99}-beta{number() % 9}",
        lambda: f"{int(rng.integers(1900, 2100))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}T10:{int(rng.integers(10, 60))}:00",
        lambda: f"commit {some(hexed, 7, 13)}", lambda: "-".join(some(hexed, k, k + 1) for k in (8, 4, 4, 4, 12)), lambda: f"+1 ({number()}) {number()}-{number()}",
        lambda: " ".join(str(int(rng.integers(1000, 9999))) for _ in range(4)), lambda: f"the {('secret', 'token', 'password', 'private')[rng.integers(4)]} {word()} of {word()}",
        lambda: f"ISBN {number()}-{number()}-{number()}", lambda: f"{word()}-{word()}-{word()}-{word()}",
    )
    out = []
    for _ in range(n):
        words = (lines[rng.integers(len(lines))] if lines and rng.random() < 0.7 else "").split(" ")
        at = int(rng.integers(0, len(words) + 1))
        out.append(" ".join([*words[:at], kinds[rng.integers(len(kinds))](), *words[at:]]))
    return out


def learn(docs: DataFrame, o: Options = Options()) -> Field:
    """Field from a bounded sample of (doc_id, text): the rows with the smallest hash of doc_id."""
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.sample_docs).distinct()
    rows = known.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return fit([r["text"] for r in sorted(rows.distinct().collect(), key=lambda r: (r["doc_id"], r["text"]))], o)


def fit(texts: list[str], o: Options) -> Field:
    """Field from sampled texts and generated lines."""
    rng = np.random.Generator(np.random.PCG64(o.seed))
    marked = [[(len(t[:a].encode()), len(t[:b].encode())) for *_, (a, b) in base_spans(t)] for t in texts]
    lines = _labelled(texts, marked)
    order = rng.permutation(len(lines))[: 2 * o.generated]
    whole = [x for t in texts for x in t.split("\n") if x]
    harmless = _harmless(rng, whole, o.generated)
    found = [[(len(t[:a].encode()), len(t[:b].encode())) for *_, (a, b) in base_spans(t)] for t in harmless]
    lines = [lines[k] for k in order] + _labelled(*_generated(rng, whole, o.generated)) + _labelled(harmless, found)
    return train(lines, o.steps)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of (doc_id, text): doc_id and spans, ordered by start, then kind, of struct(kind, start, end)."""
    order = {k: n for n, k in enumerate((*BASE, ADDED))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                t = Tokens(texts)
                extra: dict[int, list[tuple[int, int]]] = {}
                for a, b in field.decode(t.x @ field.emit, t.line):
                    extra.setdefault(int(t.text[a]), []).append((int(t.start[a]), int(t.end[b - 1])))
                # A pattern needs one of the names, or a token as long as its shortest secret.
                doubt = set(np.unique(t.text[t.named | (t.end - t.start >= 16)]).tolist()) | set(extra)
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in sorted(doubt):
                    raw, first = texts[k], int(t.bounds[k])
                    text = raw.decode()
                    spans = [(a, b, kind) for a, b, kind, _ in base_spans(text)]
                    places = [(len(raw[: a - first].decode()), len(raw[: b - first].decode())) for a, b in extra.get(k, [])]
                    spans += [(a, b, ADDED) for a, b in places if not any(a < y and x < b for x, y, _ in spans)]
                    out[k] = [{"kind": c, "start": a, "end": b} for a, b, c in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])
        free_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the patterns' spans, the SHA-256 of their list, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return scanned.select("doc_id", *[of(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def base_sha256(text: str | None) -> str:
    """The digest of one text, for comparison."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in base_spans(text or "")).encode()).hexdigest()
