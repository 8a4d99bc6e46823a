"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on labelled spans: windows of sampled texts into which written
forms of e-mail addresses, IP addresses, card and phone numbers and secrets (access tokens, keys,
passwords behind their names) are set, with look-alikes (dates, amounts, versions, hashes without
a name) left unlabelled. It reads overlapping windows. Every span that can stand holds a digit, an
@ or an "at" with a "dot" behind it, so windows without those are not read. Spans of all windows
of a text are reconciled at once: of overlapping ones that with most context on both sides
stands, and a secret that its window cuts off goes on into the next ones as far as its characters do. A span that repeats or overlaps a pattern's is dropped, and so is one that its kind rules
out (a card number failing Luhn's test, say).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right as bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import tuned

#: The kinds that have patterns; of the last, spans are the tagger's alone.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Characters of a window and between windows; hidden units of each direction.
WINDOW, STRIDE, HIDDEN = 128, 64, 12
#: Texts sampled for training windows; windows of a training step, steps, learning rate.
SAMPLE, BATCH, STEPS, RATE = 400, 64, 900, 0.02
#: Windows that a task reads at once.
AT_ONCE = 512
#: Characters of a text from which its training windows come, taken anywhere in it.
PART = 20_000
#: What every span holds.
TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]|(?<= )at [^ ]{1,40} dot ", re.IGNORECASE)
#: Names before a secret, and a secret: 12 to 128 characters, a digit among them.
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)", re.IGNORECASE)
_SECRET = re.compile(r"(?=[^0-9]*[0-9])[A-Za-z0-9+/=_.~-]{12,128}")

#: What a text has of its own that looks like a named secret; nobody has labelled it.
_UNLABELLED = re.compile(rf"(?:{_NAMED.pattern})[^A-Za-z0-9]{{0,4}}{_SECRET.pattern}", re.IGNORECASE)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: later ones fail alike, and a match ends a run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """The spans of the patterns: leftmost, not overlapping within a kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def plausible(kind: int, s: str, before: str = "") -> bool:
    """Whether a span that the tagger found, behind the characters before, can be of its kind at all."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9].*(?:(?:@|[\[(] ?at ?[\])]).*[A-Za-z0-9].*(?:\.|[\[(] ?dot ?[\])])| at [^ ]{1,40} dot ).*[A-Za-z]", s, re.IGNORECASE))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 4:
        return bool(_SECRET.fullmatch(s)) and bool(_NAMED.search(before))
    return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", s)


def char_ids(c: np.ndarray) -> np.ndarray:
    """Printable ASCII, each by itself; 95: blanks; 96: letters beyond; 97: padding is 98."""
    out = np.where((c >= 33) & (c < 127), c - 32, 96)
    return np.where((c == 32) | ((c >= 9) & (c <= 13)), 95, out).astype(np.int16)


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF over tags (O, and begin and
    inside of each kind)."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": rng.normal(0, 0.3, (2 * h, self.TAGS)), "bias": np.zeros(self.TAGS), "trans": np.zeros((self.TAGS, self.TAGS)), "start": np.zeros(self.TAGS)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (99, 4 * h))
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # gates start open
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        self.p["bias"][0] = 2.0
        # an inside tag only follows its own kind
        self.allowed = np.zeros((self.TAGS, self.TAGS))
        for k in range(1, self.TAGS):
            if k % 2 == 0:
                self.allowed[:, k] = -30.0
                self.allowed[[k - 1, k], k] = 0.0
        for key in self.p:
            self.p[key] = self.p[key].astype(np.float32)

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction, (time, rows, HIDDEN)."""
        x = x if d == "f" else x[:, ::-1]
        wx, wh, h_ = self.p[f"x{d}"], self.p[f"h{d}"], HIDDEN
        rows, time = x.shape
        h, c = np.zeros((rows, h_), np.float32), np.zeros((rows, h_), np.float32)
        hs, kept = np.empty((time, rows, h_), np.float32), []
        for t in range(time):
            z = wx[x[:, t]] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * h_]))
            i, f, o, g = s[:, :h_], s[:, h_ : 2 * h_], s[:, 2 * h_ :], np.tanh(z[:, 3 * h_ :])
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[t] = h
        return (hs if d == "f" else hs[::-1]), kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, d)[0] for d in "fb"], 2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window (rows, time)."""
        e = self.emissions(x)
        trans = (self.p["trans"] + self.allowed).astype(np.float32)
        time, rows, k = e.shape
        score, back = self.p["start"] + e[0] + self.allowed[0], np.empty((time, rows, k), np.int8)
        for t in range(1, time):
            all_ = score[:, :, None] + trans
            back[t] = all_.argmax(1)
            score = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        tags = np.empty((rows, time), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[t], tags[:, t, None].astype(np.int64), 1)[:, 0]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y (rows, time) and its gradients."""
        rows, time = x.shape
        hf, kf = self.run(x, "f", True)
        hb, kb = self.run(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        trans = self.p["trans"].astype(np.float64) + self.allowed

        # forward and backward chances, scaled to one at each step
        step, low = np.exp(trans), e.max(2, keepdims=True)
        here = np.exp(e - low)
        fwd, bwd, scale = np.empty_like(e), np.ones_like(e), np.empty((time, rows, 1))
        for t in range(time):
            a = (np.exp(self.p["start"] + self.allowed[0]) if t == 0 else fwd[t - 1] @ step) * here[t]
            scale[t] = a.sum(1, keepdims=True)
            fwd[t] = a / scale[t]
        here /= scale
        for t in range(time - 2, -1, -1):
            bwd[t] = (here[t + 1] * bwd[t + 1]) @ step.T
        z = (np.log(scale) + low).sum((0, 2))
        de = fwd * bwd
        g = {"trans": step * (fwd[:-1].reshape(-1, self.TAGS).T @ (here[1:] * bwd[1:]).reshape(-1, self.TAGS)), "start": de[0].sum(0)}
        ty = y.T.astype(np.int64)
        at = np.arange(rows)
        gold = self.p["start"][ty[0]] + np.take_along_axis(e, ty[:, :, None], 2)[:, :, 0].sum(0) + trans[ty[:-1], ty[1:]].sum(0)
        taken = np.bincount((ty[:-1] * self.TAGS + ty[1:]).ravel(), minlength=self.TAGS**2)
        g["trans"] -= taken.reshape(trans.shape)
        g["start"] -= np.bincount(ty[0], minlength=self.TAGS)
        de[np.arange(time)[:, None], at[None, :], ty] -= 1
        de /= rows
        g["trans"] /= rows
        g["start"] /= rows
        g["out"] = np.einsum("tbh,tbk->hk", both, de)
        g["bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T.astype(np.float64)
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[::-1, :, HIDDEN:])):
            wh = self.p[f"h{d}"].astype(np.float64)
            xs = x if d == "f" else x[:, ::-1]
            dzs = np.empty((time, rows, 4 * HIDDEN))
            nh, nc = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
            for t in range(time - 1, -1, -1):
                i, f, o, gg, before, tc, _ = kept[t]
                dht = part[t] + nh
                dc = nc + dht * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1, out=dzs[t])
                nh, nc = dz @ wh.T, dc * f
            flat = dzs.reshape(-1, 4 * HIDDEN)
            g[f"x{d}"] = (xs.T.reshape(-1, 1) == np.arange(len(self.p[f"x{d}"]))).T.astype(np.float64) @ flat
            g[f"h{d}"] = np.concatenate([k[6] for k in kept]).T.astype(np.float64) @ flat
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 9) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros(v.shape) for k, v in self.p.items()}
        v = {k: np.zeros(v.shape) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            part = rng.integers(0, len(x), BATCH)
            _, g = self.gradients(x[part], y[part])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def written(rng: np.random.Generator) -> tuple[int, str]:
    """A made-up piece of personal data in one of its written forms; kind -1: a look-alike."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(a: int, b: int) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    kind = min(int(rng.integers(-2, len(KINDS) + 1)), 4)  # secrets twice as often: they are told by what stands before them
    if kind == 0:
        user = word(2, 9) + pick("", ".", "_", "-") + pick(word(2, 8), digits(2), "")
        host = word(3, 9) + pick("", str(rng.integers(10)))
        at, dot = (("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "))[rng.integers(8)]
        return 0, user.strip(".-_") + at + host + pick("", ".example") + dot + pick("com", "net", "org", "de", "fr")
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return 1, pick(".", ".", ".", "[.]", "(.)", " . ", ",").join(parts)
    if kind == 2:
        n = int(rng.choice([13, 15, 16, 16, 16, 19]))
        body = digits(n - 1)
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick("", "", " ", "-", ".")
        return 2, sep.join(number[i : i + 4] for i in range(0, n, 4))
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return 3, pick(f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"0{digits(2)}/{b}{c}")
    if kind == 4:
        return 4, secret(rng)
    y, mo, d = rng.integers(1950, 2030), rng.integers(1, 13), rng.integers(1, 29)
    return -1, pick(f"{y}-{mo:02}-{d:02}", f"{d}.{mo}.{y}", f"{rng.integers(1, 999)}.{digits(2)}", f"v{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}", digits(int(rng.integers(1, 9))), f"{mo:02}:{d:02}", rng.bytes(20).hex(), f"{pick('sha', 'id', 'commit', 'file')} = \"{rng.bytes(20).hex()}\"", f"{y}-{y + 3}", f"{digits(2)} @ {digits(2)}")


#: What stands before a secret in its written forms, and behind it.
FRAMES = (('token = "', '"'), ("token: ", ""), ('api_key = "', '"'), ("api-key: ", ""), ("secret=", ""), ("password: ", ""), ('passwd="', '"'), ("access_key ", ""), ("Authorization token ", ""), ("secret = '", "'"), ("password='", "',"), ("auth: ", ";"), ("auth_token=", ""))


#: Marks that stick to the end of a span.
NOISE = (".", ",", ";", ")", "!", "?", "###", "&&&", "$$$", "%%%", "***", "!!!")


def secret(rng: np.random.Generator) -> str:
    """A made-up secret: hexadecimal, or letters of both cases with digits and marks."""
    n = int(rng.integers(12, 65) if rng.random() < 0.7 else rng.integers(65, 129))
    if rng.random() < 0.5:
        return rng.bytes(64).hex()[: n - 1] + str(rng.integers(10))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "_-"
    return "".join(letters[i] for i in rng.integers(0, len(letters), n - 1)) + str(rng.integers(10))


def training(texts: list[str], rows: int = 8000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts with written forms set into them, and their tags. Named secrets that the texts hold
    themselves are taken out: left in, without a label, they would teach the tagger to pass them by."""
    rng = np.random.default_rng(seed)
    x, y = np.full((rows, WINDOW), 98, np.int16), np.zeros((rows, WINDOW), np.int8)
    texts = [t for t in (_UNLABELLED.sub("", t) for t in texts) if t] or ["and so on "]
    for r in range(rows):
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(0, max(1, len(t) - WINDOW)))
        body, marks = t[at : at + WINDOW], []
        for _ in range(int(rng.integers(0, 3))):
            kind, s = written(rng)
            front, behind = FRAMES[rng.integers(len(FRAMES))] if kind == 4 else ("", "")
            gaps = [i for i, c in enumerate(body) if c == " " and not any(a <= i < b for _, a, b in marks)] or [len(body)]
            where = int(gaps[rng.integers(len(gaps))])
            glue = " " if rng.random() < 0.9 else ""
            lead = (glue if where == len(body) else " ") + front
            if rng.random() < 0.25:
                behind += NOISE[rng.integers(len(NOISE))]
            more = len(lead) + len(s) + len(behind)
            marks = [(k, a + more, b + more) if a >= where else (k, a, b) for k, a, b in marks]
            body = body[:where] + lead + s + behind + body[where:]
            marks.append((kind, where + len(lead), where + len(lead) + len(s)))
        marks += [s for s in patterns(body) if not any(a < s[2] and s[1] < b for _, a, b in marks)]
        body = body[:WINDOW]
        x[r, : len(body)] = char_ids(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32))
        for kind, a, b in marks:
            # a span that the window cuts off is tagged up to its edge
            if kind >= 0 and a < WINDOW:
                y[r, a] = 1 + 2 * kind
                y[r, a + 1 : b] = 2 + 2 * kind
    return x, y


def windows(text: str) -> list[int]:
    """Starts of the windows of a text that hold a trigger."""
    starts = set()
    for m in TRIGGER.finditer(text):
        at = m.start() // STRIDE
        starts.update((at * STRIDE, max(0, at - 1) * STRIDE))
    return sorted(starts)


#: What goes on behind a secret that a window cuts off; a full stop at its end is the sentence's.
_REST = re.compile(r"[A-Za-z0-9+/=_.~-]*(?<!\.)")


def continued(kind: int, text: str, start: int, end: int, cut: bool) -> int | None:
    """Where a span ends that was read up to end: a secret goes on as far as its characters do, whatever
    windows they lie in, so none is left with its tail outside; other kinds end where they were read.
    None for what would be too long, and for a span of another kind that its window cuts off, as
    the next window holds it whole."""
    if kind != 4:
        return None if cut else end
    end = max(end, _REST.match(text, end, start + 256).end())
    return end if end - start <= 128 else None


def spans_of(tags: np.ndarray) -> Iterator[Span]:
    """Spans of one window's tags."""
    begin, kind = -1, -1
    for t in (*np.flatnonzero(tags).tolist(), len(tags)):
        tag = int(tags[t]) if t < len(tags) else 0
        if begin >= 0 and (t != end or tag % 2 == 1 or tag == 0):
            yield kind, begin, end
            begin = -1
        if tag:
            if begin < 0:
                begin, kind = t, (tag - 1) // 2
            end = t + 1


def reconciled(found: list[tuple[int, int, int, int]]) -> list[Span]:
    """Of spans (context, kind, start, end) that overlap, those with most context."""
    out: list[Span] = []  # by start; none overlaps another, so only neighbours can be met
    for _, kind, a, b in sorted(found, key=lambda s: (-s[0], s[2], s[3], s[1])):
        at = bisect(out, a, key=lambda s: s[1])
        if (not at or out[at - 1][2] <= a) and (at == len(out) or b <= out[at][1]):
            out.insert(at, (kind, a, b))
    return out


def apart(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans of found that overlap none of base."""
    starts, ends = (np.sort(np.array([s[i] for s in base], np.int64)) for i in (1, 2))
    # spans that begin before this one's end, less those that end before its start
    return [s for s in found if np.searchsorted(starts, s[2], "left") == np.searchsorted(ends, s[1], "right")]


def find_all(texts: list[str], tagger: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and those that the tagger adds."""
    where = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for at in range(0, len(where), AT_ONCE):
        part = where[at : at + AT_ONCE]
        x = np.full((len(part), WINDOW), 98, np.int16)
        for r, (i, s) in enumerate(part):
            body = texts[i][s : s + WINDOW]
            x[r, : len(body)] = char_ids(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32))
        tags = tagger.decode(x)
        for r in np.flatnonzero(tags.any(1)):
            i, s = part[r]
            n = len(texts[i])
            for kind, a, b in spans_of(tags[r]):
                b = min(b, n - s)
                left, right = a if s else WINDOW, WINDOW - b if s + WINDOW < n else WINDOW
                end = continued(kind, texts[i], s + a, s + b, not right)
                if kind == 4:
                    right = WINDOW  # its end is known
                if end is not None and s + a < end:
                    found.setdefault(i, []).append((min(left, right), kind, s + a, end))
    for i, t in enumerate(texts):
        base = patterns(t)
        more = apart([s for s in reconciled(found.get(i, [])) if plausible(s[0], t[s[1] : s[2]], t[max(0, s[1] - 24) : s[1]])], base)
        yield base, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def finder(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger()
        tagger.p = shared.value
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"]]
            for at in range(0, len(texts), 256):
                for base, more in find_all(texts[at : at + 256], tagger):
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(BASE))]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(base) + len(more), len(more)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])
            out.insert(0, "doc_id", batch["id"].astype("Int64").array)
            yield out

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added) for every row.

    The counts and base_sha256 are of the patterns' spans, spans lists those and the n_added
    ones that the tagger adds, n_spans in all, as kind:start:end by kind and start, in code
    points, ends exclusive. Null and empty texts have no spans. The tagger is trained on about
    SAMPLE texts, chosen by a hash of the id, PART characters from anywhere in each, for `steps`
    steps; the same table gives the same tagger. Repeated rows are treated alike; an empty table
    gives an empty result. Other columns of docs are not read.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    picked = rows.filter(F.xxhash64(F.coalesce("id", F.lit(0)), F.lit(1)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53)) < share)
    begin = 1 + F.pmod(F.xxhash64(F.coalesce("id", F.lit(0)), F.lit(2)), F.greatest(F.length("text") - PART, F.lit(0)) + 1)
    sample = picked.withColumn("text", F.substring("text", begin.cast("int"), F.lit(PART))).orderBy("id", "text").limit(2 * SAMPLE).toPandas()
    tagger = Tagger().fit(*training(sample["text"].dropna().tolist()), steps)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"
    return rows.mapInPandas(finder(spark.sparkContext.broadcast(tagger.p)), schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
