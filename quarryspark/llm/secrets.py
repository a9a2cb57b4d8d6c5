"""Secret scans: fixed patterns find the base spans, and a character convolutional network in numpy judges every other
candidate with its surrounding context. Its scores are calibrated on held-out findings, and for each kind of context the
threshold is the highest that keeps the floor of recall on others; precision there is reported and never bought by recall."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, by_batch, fresh_path, removed, whole_text

KINDS = ("assign", "access", "hex")
LEARNED = "learned"

#: The patterns of the base spans, and the least length of the named part.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Kinds of context of a candidate: a word of the named part shortly before it, or none.
CONTEXTS = ("keyed", "bare")
KEYED = re.compile(r"(?ai)password|passwd|secret|token|api_?key")
#: Runs that are ordinary wherever they stand: words, numbers and both in turn, between separators (versions, dates,
#: paths, names); next to an @ or behind :// they are the parts of addresses.
_WORD = r"(?:[A-Za-z]?[a-z]{2,}|[A-Z]{2,})"
_PIECE = rf"(?:{_WORD}(?:\d{{1,4}}{_WORD})*(?:\d{{1,4}})?|[A-Za-z]{{0,2}}\d{{1,4}}[A-Za-z]{{0,2}}|\d{{1,2}}T\d{{1,6}})"
ORDINARY = re.compile(rf"[+/_.=-]*{_PIECE}(?:[+/_.=-]+{_PIECE})*[+/_.=-]*")
#: Forms and alphabets of planted secrets.
FORMS = ("dotted", "prefix", "end", "plain")
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
BASE62 = _LOW + _UP + _DIGITS
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOW + _DIGITS, _UP + _DIGITS, BASE62, BASE62 + "+/", BASE62 + "-_")

#: A candidate is a run of these characters of at least CANDIDATE length with a digit and a letter; shorter runs, and those
#: of one kind of character, are no findings of the method (a base pattern may still find them).
RUN = np.zeros(256, bool)
RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
CANDIDATE = 12
#: The network's window: context, the candidate's head and tail, context. Longer candidates have several windows.
BEFORE, HEAD, TAIL, AFTER = 24, 32, 12, 12
WINDOW = BEFORE + HEAD + TAIL + AFTER


def base_spans(text: str, raw: bytes, long_runs: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points; per kind leftmost and not overlapping, those that are too short dropped."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if long_runs:
        out += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return out


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all long enough runs, and whether each is a candidate."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(RUN[b].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= CANDIDATE
    start, end = start[long], end[long]
    if not len(start):
        return start, end, np.zeros(0, bool)
    both = np.ones(len(start), bool)
    for kind in (DIGIT, LETTER):
        n = np.concatenate([[0], np.cumsum(kind[b], dtype=np.int32)])
        both &= n[end] > n[start]
    return start, end, both


def _window(text: str, start: int, end: int, head: int, tail: int) -> np.ndarray:
    """Character classes of the window on the parts [head, head + HEAD) and [tail, end) of a candidate, with the context
    around them: printable ASCII from 2, others 1, nothing 0; 128 more inside the candidate."""
    out = np.zeros(WINDOW, np.uint8)

    def put(at: int, a: int, b: int) -> None:
        codes = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<u4")
        inside = (np.arange(a, a + len(codes)) >= start) & (np.arange(a, a + len(codes)) < end)
        out[at : at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 30, 1) + 128 * inside

    first = max(0, head - BEFORE)
    put(BEFORE - (head - first), first, head)
    middle = min(end, head + HEAD)
    put(BEFORE, head, middle)
    last = min(end, max(middle, tail) + TAIL)
    if last > middle:
        put(BEFORE + HEAD, max(middle, last - TAIL), last)
    put(BEFORE + HEAD + TAIL, last, last + AFTER)
    return out


def encoded_window(text: str, start: int, end: int) -> np.ndarray:
    """The window on a candidate's head and tail."""
    return _window(text, start, end, start, max(start + HEAD, end - TAIL))


def encoded_windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """All windows on a candidate: its head and tail, and for a longer one those that slide over what is between, so that
    every character of it is in one. The candidate's score is the highest of theirs."""
    step = HEAD + TAIL
    return [encoded_window(text, start, end)] + [_window(text, start, end, k, k + HEAD) for k in range(start + HEAD, end - TAIL, step)]


@dataclass
class Network:
    """Embedding, two convolutions, the maxima inside and outside the candidate, and a logistic unit."""

    p: dict[str, np.ndarray]
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(CONTEXTS, 2.0))
    #: Slope and offset of the logits: the calibration.
    scale: tuple[float, float] = (1.0, 0.0)
    #: By kind of context, on held-out examples: (positives, recall, precision).
    report: dict[str, tuple[int, float, float]] = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        """The lowest of the kinds'."""
        return min(self.thresholds.values())

    @staticmethod
    def fresh(channels: int = 16, width: int = 8, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) * np.sqrt(2 / np.prod(s[:-1]))).astype(np.float32)
        return Network({"e": n(128, width) * 3, "w1": n(5 * (width + 1), channels), "b1": np.zeros(channels, np.float32), "w2": n(3 * channels, channels), "b2": np.zeros(channels, np.float32), "w3": n(2 * channels, 1), "b3": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, inside = self.p, x >= 128
        h0 = np.concatenate([p["e"][x & 127], inside[..., None].astype(np.float32)], axis=2)
        c1 = _columns(h0, 5)
        a1 = np.maximum(c1 @ p["w1"] + p["b1"], 0)
        c2 = _columns(a1, 3)
        a2 = np.maximum(c2 @ p["w2"] + p["b2"], 0)
        top_in, top_out = np.where(inside[..., None], a2, -1).argmax(1), np.where(inside[..., None], -1, a2).argmax(1)
        take = lambda at: np.take_along_axis(a2, at[:, None], 1)[:, 0]
        pooled = np.concatenate([take(top_in), take(top_out)], axis=1)
        z = (pooled @ p["w3"] + p["b3"])[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (x, c1, a1, c2, a2, top_in, top_out, pooled)

    def gradients(self, y: np.ndarray, prob: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, c1, a1, c2, a2, top_in, top_out, pooled) = self.p, kept
        d = ((prob - y) / len(y)).astype(np.float32)[:, None]
        g = {"w3": pooled.T @ d, "b3": d.sum(0)}
        dp, da2, n = d @ p["w3"].T, np.zeros_like(a2), a2.shape[2]
        rows, cols = np.arange(len(x))[:, None], np.arange(n)[None]
        np.add.at(da2, (rows, top_in, cols), dp[:, :n])
        np.add.at(da2, (rows, top_out, cols), dp[:, n:])
        da2 *= a2 > 0
        g["w2"], g["b2"] = c2.reshape(-1, c2.shape[2]).T @ da2.reshape(-1, n), da2.sum((0, 1))
        da1 = _spread(da2 @ p["w2"].T, 3, a1.shape) * (a1 > 0)
        g["w1"], g["b1"] = c1.reshape(-1, c1.shape[2]).T @ da1.reshape(-1, n), da1.sum((0, 1))
        dh0 = _spread(da1 @ p["w1"].T, 5, (*x.shape, p["e"].shape[1] + 1))[..., :-1]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], (x & 127).ravel(), dh0.reshape(-1, dh0.shape[2]))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, state: dict, batch: int = 64, rate: float = 0.004) -> None:
        """Goes over the examples once in their order (Adam); `state` goes on from call to call."""
        for at in np.array_split(np.arange(len(x)), max(1, len(x) // batch)):
            t = state["t"] = state.get("t", 0) + 1
            for k, g in self.gradients(y[at], *self.forward(x[at])).items():
                m, v = state.get(k, (0, 0))
                m, v = state[k] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, logit: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """Slope and offset by Newton's method (Platt's scaling, with smoothed targets), from logits not calibrated, each
        as often as `times` says."""
        self.scale = (1.0, 0.0)
        z = np.stack([logit, np.ones(len(logit))], axis=1)
        n, m, at = (y * times).sum(), ((1 - y) * times).sum(), np.array([1.0, 0.0])
        target = np.where(y == 1, (n + 1) / (n + 2), 1 / (m + 2))
        loss = lambda w: times @ (np.logaddexp(0, z @ w) - target * (z @ w)) + ((w - [1, 0]) ** 2).sum() / 2
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
            step = np.linalg.solve((z * (times * q * (1 - q))[:, None]).T @ z + np.eye(2), z.T @ (times * (q - target)) + at - [1, 0])
            while (moved := np.abs(step).max()) > 1e-9 and loss(at - step) > loss(at):
                step = step / 2
            at = at - step
            if moved <= 1e-9:
                break
        if at[0] > 0:
            self.scale = (float(at[0]), float(at[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        prob = np.concatenate([np.zeros(0), *[self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)]])
        return prob if self.scale == (1.0, 0.0) else self.calibrated(_logits(prob))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * logit + self.scale[1])))


def highest(net: Network, windows: list[list[np.ndarray]]) -> np.ndarray:
    """The highest score of each candidate's windows."""
    n = np.array([len(w) for w in windows], np.int64)
    return np.maximum.reduceat(net(np.array([x for w in windows for x in w])), np.cumsum(n) - n) if len(n) else np.zeros(0)


def _columns(h: np.ndarray, k: int) -> np.ndarray:
    padded = np.pad(h, ((0, 0), (k // 2, k // 2), (0, 0)))
    return np.concatenate([padded[:, i : i + h.shape[1]] for i in range(k)], axis=2)


def _spread(d: np.ndarray, k: int, shape: tuple) -> np.ndarray:
    out, c = np.zeros((shape[0], shape[1] + k - 1, shape[2]), np.float32), shape[2]
    for i in range(k):
        out[:, i : i + shape[1]] += d[..., i * c : (i + 1) * c]
    return out[:, k // 2 : k // 2 + shape[1]]


def findings(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """The base spans, and the other candidates as (start, end), in code points. A candidate that a base span touches
    belongs to that span."""
    raw = text.encode("utf-8", "surrogatepass")
    start, end, candidate = runs(raw)
    base = base_spans(text, raw, bool(len(start)) and int((end - start).max()) >= LEAST["hex"])
    start, end = start[candidate], end[candidate]
    if not len(start):
        return base, []
    if len(raw) != len(text):  # from bytes to code points
        point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)])
        start, end = point[start], point[end]
    return base, [(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True) if not any(a < y and x < b for x, y, _ in base)]


def _shuffled(value: str, r: np.random.Generator) -> str:
    """Another value with each character's class kept."""
    pick = lambda s: s[int(r.integers(len(s)))]
    if re.fullmatch(r"[0-9a-f]+", value):
        return "".join(pick("0123456789abcdef") for _ in value)
    return "".join(pick("0123456789") if c.isdigit() else pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else pick("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in value)


def context(text: str, start: int) -> str:
    return CONTEXTS[0] if KEYED.search(text, max(0, start - BEFORE), start) else CONTEXTS[1]


def ordinary(text: str, start: int, end: int) -> bool:
    """Whether a candidate is part of a mail address, or of words and numbers (URLs, versions, names)."""
    return "@" in (text[start - 1 : start], text[end : end + 1]) or bool(ORDINARY.fullmatch(text, start, end))


def planted(r: np.random.Generator) -> tuple[str, str]:
    """A made secret and its form: three dotted parts, or random characters of one alphabet, some with a prefix or an
    end."""
    pick = lambda letters, n: "".join(letters[int(i)] for i in r.integers(0, len(letters), n))
    form, size = FORMS[int(r.integers(len(FORMS)))], int(r.integers(16, 65))
    if form == "dotted":
        return "eyJ" + ".".join(pick(ALPHABETS[-1], int(n)) for n in r.integers(16, 60, 3)), form
    letters = BASE62 if form == "prefix" and r.random() < 0.5 else ALPHABETS[int(r.integers(len(ALPHABETS)))]
    value = pick(letters, size)
    while not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):  # nothing fixed that the network could learn
        value = pick(letters, size)
    return {"prefix": pick(_LOW, int(r.integers(2, 5))) + "_-"[int(r.integers(2))] + value, "end": value + "=" * int(r.integers(1, 3)), "plain": value}[form], form


def address(words: list[str], r: np.random.Generator) -> tuple[str, str, str]:
    """(before, run, after) of a made mail address, URL, version or name of the given words."""
    w = lambda: words[int(r.integers(len(words)))]
    d = lambda n=100: str(int(r.integers(n)))
    host = f"{w()}{d()}.{w()}.{w()[:3]}"
    return (
        ("", f"{w()}.{w()}.{d()}", f"@{host}"), (f"{w()}.{d()}@", host, ""), ("https:", f"//{host}/{w()}/{w()}-{w()}-{d(3000)}", ""), ("", f"{w()}-{d(20)}.{d(20)}.{d(20)}", ""),
        ("", f"v{d(20)}.{d(20)}.{d(20)}-{w()}.{d(10)}", ""), ("", f"{w()}_{w()}_{d(3000)}", ""), ("", f"{w()}{d()}{w()}{d()}", ""), ("", f"20{d(90)}-{d(13)}-{d(32)}T{d(25)}", ":00"),
    )[int(r.integers(8))]


#: Fixed values of the training: how often a small corpus draws from a document, for about DRAWN in all; windows that a
#: group holds about, and groups of a round at most; rounds, and windows that a round goes over at least; steps of a logit.
DRAWS, DRAWN, GROUP, GROUPS, ROUNDS, ROUND, STEPS = 16, 20_000, 8_192, 256, 6, 10_000, 64
TRAIN, CALIBRATE, DECIDE = range(3)
_WORD_AT = re.compile(r"(?<!\S)\S+")
_EXAMPLE = "part int, y int, kind string, form string, found int, n int, windows binary, key long"


def examples(text: str, h: int, draws: int) -> Iterator[tuple[int, int, str, str, int, list[np.ndarray], int]]:
    """(part, y, kind of context, form, found, windows, key) of a text's examples. Positive are its base spans, with fresh
    values or planted secrets in the values' places, and planted secrets in the places of `draws` ordinary words of it;
    negative are these words, made addresses and names there, and all candidates that are `ordinary`. Of a quarter of
    the places, the examples are held out, for CALIBRATE and others for DECIDE. `found` is 1 once a base span, 2 once a
    word, else 0."""
    r = np.random.default_rng((h & (2**63 - 1), len(text)))
    base, other = findings(text)

    def put(a: int, b: int, before: str, run: str, after: str) -> tuple[list[np.ndarray], str, int]:
        t, at = text[max(0, a - 64) : a] + before + run + after + text[b : b + 64], min(a, 64) + len(before)
        return encoded_windows(t, at, at + len(run)), context(t, at), int(r.integers(1 << 62))

    def parts() -> tuple[int, ...]:
        return (CALIBRATE, DECIDE) if r.random() < 0.25 else (TRAIN,)

    def positive(part: int, a: int, b: int, value: str | None, found: int):
        run, form = planted(r) if value is None else (_shuffled(value, r), "base")
        windows, kind, key = put(a, b, "", run, "")
        return part, 1, kind, form, found, windows, key

    def negative(part: int, a: int, b: int, made: tuple[str, str, str]):
        windows, kind, key = put(a, b, *made)
        return part, 0, kind, "", 0, windows, key

    for a, b, kind in base:
        start = ASSIGN.match(text, a).start(2) if kind == "assign" and ASSIGN.match(text, a) else a
        first, own = int(r.integers(2)), parts()
        for part in own:
            for k in range(draws):
                yield positive(part, start, b, text[start:b] if (k + first) % 2 else None, int(k == 0 and part == own[0]))
    for a, b in other:
        if ordinary(text, a, b):
            for part in parts():
                yield negative(part, a, b, ("", text[a:b], ""))
    for at in r.integers(0, len(text), draws).tolist() if text else ():
        word = _WORD_AT.search(text, at) or _WORD_AT.search(text)
        if word is None or any(word.start() < y and x < word.end() for x, y in [s[:2] for s in base] + other):
            continue
        names, made, own = re.findall(r"[A-Za-z][a-z]{2,11}", text[max(0, at - 200) : at + 200]), r.random() < 0.5, parts()
        for part in own:
            yield positive(part, *word.span(), None, 2 if part == own[0] else 0)
            yield negative(part, *word.span(), address(names, r) if made and names else ("", word[0], ""))


def _made(documents: DataFrame, id_col: str, text_col: str, draws: int) -> DataFrame:
    """The examples of every row and whole text."""

    def make():
        def each(batch: pa.RecordBatch) -> dict | None:
            rows = [e for text, h in zip(batch["text"].to_pylist(), batch["h"].to_pylist(), strict=True) for e in examples(text, h, draws)]
            if not rows:
                return None
            part, y, kind, form, found, windows, key = zip(*rows, strict=True)
            return {"part": part, "y": y, "kind": kind, "form": form, "found": found, "n": [len(w) for w in windows], "windows": [b"".join(x.tobytes() for x in w) for w in windows], "key": key}

        return each

    return by_batch(documents.select(F.xxhash64(id_col).alias("h"), whole_text(text_col).alias("text")), _EXAMPLE, make)


def _windows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["windows"].to_pylist()), np.uint8).reshape(-1, WINDOW)


def _round(rows: DataFrame, net: Network, groups: int, rate: float) -> Network:
    """The mean of the networks that the groups of the rows train from `net`; a group is one pass in the order of `key`, and
    read in bounded batches."""
    spark = rows.sparkSession
    bounded_batches(spark)
    sent, names = spark.sparkContext.broadcast(net.p), sorted(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(g: int, own: Network, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "n": pa.array([n], pa.int64()), "p": pa.array([np.concatenate([own.p[k].ravel() for k in names]).astype("<f4").tobytes()], pa.binary())})

        at = None
        for whole in batches:
            ends = np.flatnonzero(np.diff(whole["g"].to_numpy(), append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                batch = whole.slice(a, b - a)
                if (g := batch["g"][0].as_py()) != at:
                    if at is not None:
                        yield out(at, own, n)
                    at, own, state, n = g, Network(dict(sent.value)), {}, 0
                x = _windows(batch)
                own.train(x, np.repeat(batch["y"].to_numpy(), batch["n"].to_numpy()).astype(np.float32), state, rate=rate)
                n += len(x)
        if at is not None:
            yield out(at, own, n)

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).select("g", "key", "y", "n", "windows")
    found = sorted(dealt.repartition("g").sortWithinPartitions("g", "key").mapInArrow(run, "g int, n long, p binary").collect())
    mean = np.average([np.frombuffer(f["p"], "<f4").astype(float) for f in found], axis=0, weights=[f["n"] for f in found]) if found else None
    if mean is None:
        return net
    ends = np.cumsum([net.p[k].size for k in names])[:-1]
    return Network({k: v.reshape(net.p[k].shape).astype(np.float32) for k, v in zip(names, np.split(mean, ends), strict=True)})


def _logits(prob: np.ndarray) -> np.ndarray:
    prob = np.clip(prob.astype(float), 1e-13, 1 - 1e-13)
    return np.log(prob / (1 - prob))


def _judged(rows: DataFrame, net: Network) -> list:
    """(part, y, kind, form, step, times): how many examples have a logit of a step; so many rows at most as there are steps."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            n = batch["n"].to_numpy()
            score = np.maximum.reduceat(sent.value(_windows(batch)), np.cumsum(n) - n)
            return {c: batch[c] for c in ("part", "y", "kind", "form")} | {"step": np.floor(_logits(score) * STEPS).astype(int)}

        return each

    found = by_batch(rows.select("part", "y", "kind", "form", "n", "windows"), "part int, y int, kind string, form string, step int", make)
    return found.groupBy(*found.columns).agg(F.count("*").alias("times")).collect()


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> Network:
    """A network from the examples() of every row and whole text; a small corpus draws several values a place. Without four
    base spans nothing is added (the thresholds are above 1).

    Examples are a table; a round trains groups of them side by side, each from the mean of the round before, and takes
    the mean of their networks. Rounds go over slices of the table: a large one is passed once, a small one up to ROUNDS
    times. Held-out examples are judged where they are and counted by steps of the logit: those of one half calibrate
    the scores, and the others, with other values, give each kind of context the highest threshold that keeps `recall` of
    every form of value. The driver sees the networks of a round (GROUPS of some 10 KB) and these counts. Which group an
    example is in follows from its text and id, so nothing depends on how the rows lie.
    """
    spark, n_rows = documents.sparkSession, documents.count()
    path, net = fresh_path(spark, "secret-examples"), Network.fresh()
    _made(documents, id_col, text_col, max(1, min(DRAWS, DRAWN // max(1, n_rows)))).write.parquet(path)
    made = spark.read.schema(_EXAMPLE).parquet(path)
    spans, words, total = made.agg(F.count_if(F.col("found") == 1), F.count_if(F.col("found") == 2), F.sum(F.when(F.col("part") == TRAIN, F.col("n")))).first()
    if spans < 4 or not words or not total:
        removed(spark, path)
        return net
    slices = max(1, min(ROUNDS, total // ROUND))
    groups = max(1, min(GROUPS, total // slices // GROUP))
    train = made.where(F.col("part") == TRAIN)
    for k in range(ROUNDS):
        own = train.where(F.pmod(F.col("key"), F.lit(slices)) == k % slices)
        net = _round(own, net, groups, 0.004 / (1 + k / 3))
    counts = _judged(made.where(F.col("part") != TRAIN), net)
    removed(spark, path)
    column = lambda name: np.array([c[name] for c in counts])
    part, y, kind, form, step, times = map(column, ("part", "y", "kind", "form", "step", "times"))
    half = part == CALIBRATE
    net.calibrate((step[half] + 0.5) / STEPS, y[half].astype(float), times[half].astype(float))
    y, kind, form, step, times = (x[~half] for x in (y, kind, form, step, times))
    for c in CONTEXTS:
        own = (y == 1) & (kind == c) if ((y == 1) & (kind == c)).any() else y == 1  # without an example of the kind all
        least = []
        for f in np.unique(form[own]):
            at = np.flatnonzero(own & (form == f))
            at = at[np.argsort(step[at], kind="stable")]
            up = np.cumsum(times[at])
            least.append(step[at[np.searchsorted(up, int((1 - recall) * up[-1] + 1e-9), "right")]])
        if not least:
            continue
        lowest = min(least)  # all scores of the step are above its lower end
        net.thresholds[c] = float(net.calibrated(np.array([lowest / STEPS - 1e-6]))[0])
        taken = (step >= lowest) & (kind == c)
        share = lambda a, b: float(times[a & b].sum() / times[b].sum()) if b.any() else 0.0
        net.report[c] = (int(times[own].sum()), share(step >= lowest, own), share(y == 1, taken))
    return net


def scan(documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, learned) of every row and whole text: arrays of (start, end, kind), in code points, by start and then
    by kind; `learned` are the candidates that the network takes for secrets. Null texts count as empty; rows that repeat
    are scanned each; an empty table gives no row; other columns are not read."""
    sent = documents.sparkSession.sparkContext.broadcast(net)
    place = {k: i for i, k in enumerate((*KINDS, LEARNED))}

    def make():
        model = sent.value

        def each(batch: pa.RecordBatch) -> dict:
            bases, learned, windows, at = [], [], [], []
            for n, text in enumerate(batch["text"].to_pylist()):
                base, other = findings(text)
                bases.append(sorted(base, key=lambda s: (s[0], place[s[2]])))
                learned.append([])
                windows += [encoded_windows(text, a, b) for a, b in other]
                at += [(n, a, b, model.thresholds[context(text, a)]) for a, b in other]
                if len(windows) >= 2000 or n + 1 == batch.num_rows:  # so many are held at a time
                    for (m, a, b, threshold), score in zip(at, highest(model, windows), strict=True):
                        if score >= threshold:
                            learned[m].append((a, b, LEARNED))
                    windows, at = [], []
            spans = lambda rows: [[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in rows]
            return {"id": batch["id"], "base": spans(bases), "learned": spans(learned)}

        return each

    kind = dict(documents.dtypes)[id_col]
    span = "array<struct<start:long,end:long,kind:string>>"
    return by_batch(documents.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), f"id {kind}, base {span}, learned {span}", make).withColumnRenamed("id", id_col)


def op3_secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document, as scan() defines them."""
    found = scan(documents, fit(documents))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    place = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, LEARNED)) for x in (k, i)])
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "learned"), lambda s: F.struct(s["start"].alias("a"), place[s["kind"]].alias("p"), s.alias("s")))), lambda x: x["s"])
    return found.select("doc_id", *map(n, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(ordered).alias("spans"))
