"""Personal data: fixed patterns, and a character-level BiLSTM with a CRF.

Patterns give the base spans; the tagger adds spans that they miss: the same
kinds in other notations (addresses with at and dot spelled out, phones without
a plus, cards with dots, defanged and version 6 IPs), and secrets, values that
are assigned to a key, password or token. It is a bidirectional LSTM over
classes of characters with a linear-chain CRF, trained in numpy on labelled
spans that a generator of fixed seed and size writes (its bound is TRAINING
texts), among words of syllables, letters and few words over and over. Secrets are given
apart from the spans of the four kinds. A text is cut to overlapping windows; each is decoded by Viterbi, and
the text's tags are put together by taking every character's tag from the
window in which it lies most centrally, so spans that cross windows are whole.

What is tagged stands for the whole address that it is a part of (SHAPES).

A span of any kind has a mark: a digit, an @, a spelled-out dot, or how a key begins. Windows with a
mark are decoded, and the windows that overlap them, so every character of a
window with a mark has the tag that decoding all windows would give it; other
characters have none. Added spans must be what their kind is (sound()) and
don't overlap base spans.

Defined results: null text is empty and has no spans; rows alike give rows
alike; other columns are ignored. Memory follows the decoded windows, at most
CHUNK at a time, and a text's own length.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: The first four have base patterns; secrets come from the tagger only.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
# The patterns that the base spans are defined by.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: IP from the beginnings of runs of digits only: its matches begin nowhere else.
IP_RUN = re.compile(r"(?<![0-9])" + IP.pattern)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW = 64
STRIDE = 32
HIDDEN = 20
EMBED = 12
TRAINING = 4000
EPOCHS = 9
CHUNK = 2048

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, in time linear in the text: it is tried only
    from the beginning of the run of local-part characters before each @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def octet(digits: str) -> bool:
    """Whether ASCII digits, with any zeros before them, are at most 255."""
    bare = digits.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [(a, b, "email") for a, b in email_spans(text)]
    found += [(*m.span(), "ip") for m in IP_RUN.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---- the tagger

#: Code points over 127 read as one letter class; the rest are themselves.
CLASSES = 130
PAD = 129


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(c, 128).astype(np.int64)


@dataclass
class Tagger:
    embed: np.ndarray
    inputs: np.ndarray  # of the forward and the backward LSTM: EMBED x 4 HIDDEN
    states: np.ndarray  # of both, HIDDEN x 4 HIDDEN
    biases: np.ndarray
    out: np.ndarray  # 2 HIDDEN x tags
    out_bias: np.ndarray
    moves: np.ndarray  # tags x tags
    first: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.inputs, self.states, self.biases, self.out, self.out_bias, self.moves, self.first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Outputs (T, 2, B, HIDDEN) of both LSTMs, a step of either at once, over x (T, 2, B, EMBED)."""
    steps, _, batch, _ = x.shape
    h = c = np.zeros((2, batch, HIDDEN), np.float32)
    pre = x @ wx + b[:, None]
    hs = np.empty((steps, 2, batch, HIDDEN), np.float32)
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, h_before = c, h
        c = f * before + i * g
        tc = np.tanh(c)
        h = hs[t] = o * tc
        if keep is not None:
            keep.append((i, f, o, g, before, tc, h_before))
    return hs


def _lstm_back(dh_out: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple:
    """Slopes of x, inputs, states and biases, for slopes (T, 2, B, HIDDEN) of the outputs."""
    steps, _, batch, size = x.shape
    dwh, dz_all = np.zeros_like(wh), np.empty((steps, 2, batch, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((2, batch, HIDDEN), np.float32)
    back = wh.transpose(0, 2, 1)
    for t in reversed(range(steps)):
        i, f, o, g, before, tc, h_before = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[..., :HIDDEN], dz[..., HIDDEN : 2 * HIDDEN] = dc * g * i * (1 - i), dc * before * f * (1 - f)
        dz[..., 2 * HIDDEN : 3 * HIDDEN], dz[..., 3 * HIDDEN :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
        dwh += h_before.transpose(0, 2, 1) @ dz
        dh, dc = dz @ back, dc * f
    flat = dz_all.transpose(1, 0, 2, 3).reshape(2, -1, 4 * HIDDEN)
    return dz_all @ wx.transpose(0, 2, 1), x.transpose(1, 0, 2, 3).reshape(2, -1, size).transpose(0, 2, 1) @ flat, dwh, flat.sum(axis=1)


def emissions(m: Tagger, chars: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(T, B, tags) for windows (B, T) of codes."""
    x = m.embed[chars.T]
    x = np.stack([x, x[::-1]], axis=1)
    kept: list | None = None if keep is None else []
    h = _lstm(x, m.inputs, m.states, m.biases, kept)
    both = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
    if keep is not None:
        keep.update(x=x, both=both, kept=kept)
    return both @ m.out + m.out_bias


def viterbi(m: Tagger, e: np.ndarray) -> np.ndarray:
    """The best tags (B, T)."""
    steps, batch, tags = e.shape
    score = m.first + e[0]
    back = np.empty((steps, batch, tags), np.int8)
    for t in range(1, steps):
        s = score[:, :, None] + m.moves
        back[t] = s.argmax(axis=1)
        score = s.max(axis=1) + e[t]
    out = np.empty((steps, batch), np.int8)
    out[-1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][np.arange(batch), out[t]]
    return out.T


def _crf(m: Tagger, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss and its slopes by emissions, moves and first, for tags (T, B). Forward and backward
    passes are in probabilities, scaled to one at each step."""
    steps, batch, k = e.shape
    e = e.astype(np.float64)
    top = e.max(axis=2, keepdims=True)
    local, move = np.exp(e - top), np.exp(m.moves.astype(np.float64))
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1))
    for t in range(steps):
        a = local[t] * (alpha[t - 1] @ move if t else np.exp(m.first.astype(np.float64)))
        scale[t] = a.sum(axis=1, keepdims=True)
        alpha[t] = a / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (local[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
    z = (np.log(scale) + top).sum(axis=0)[:, 0]
    at, rows = np.arange(steps)[:, None], np.arange(batch)[None, :]
    gold = m.first[tags[0]] + m.moves[tags[:-1], tags[1:]].sum(axis=0) + e[at, rows, tags].sum(axis=0)
    after = (local[1:] * beta[1:] / scale[1:]).reshape(-1, k)
    dmoves = move * (alpha[:-1].reshape(-1, k).T @ after)
    np.add.at(dmoves, (tags[:-1], tags[1:]), -1)
    de = alpha * beta
    de[at, rows, tags] -= 1
    return float((z - gold).mean()), de / batch, dmoves / batch, de[0].sum(axis=0) / batch


def fit(chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 3, batch: int = 96, rate: float = 0.012) -> Tagger:
    """A tagger of windows of codes (N, T) with tags (N, T), by Adam steps."""
    r, k = np.random.default_rng(seed), len(KINDS) + 1
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    m = Tagger(init(CLASSES, EMBED), init(2, EMBED, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 4 * HIDDEN), np.float32), init(2 * HIDDEN, k), np.zeros(k, np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    parts = m.parts()
    mean, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = r.permutation(len(chars))
        for i in range(0, len(order), batch):
            c, t = chars[order[i : i + batch]], tags[order[i : i + batch]].T
            keep: dict = {}
            e = emissions(m, c, keep)
            _, de, dmoves, dfirst = _crf(m, e, t)
            de = de.astype(np.float32)
            dboth = de @ m.out.T
            dout = keep["both"].reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k)
            dh = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
            dx, dwx, dwh, db = _lstm_back(dh, keep["x"], m.inputs, m.states, keep["kept"])
            dembed = np.zeros_like(m.embed)
            np.add.at(dembed, c.T, dx[:, 0] + dx[::-1, 1])
            slopes = [dembed, dwx, dwh, db, dout, de.sum(axis=(0, 1)), dmoves, dfirst]
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for p, g, a, b in zip(parts, slopes, mean, square):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def labelled(count: int = TRAINING, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Generated texts of up to some 200 characters with their labelled spans: each kind
    in notations that the patterns know and that they miss, in running text, lists,
    tables and settings, and numbers and names that are none of them."""
    r = random.Random(seed)
    pick = r.choice
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    syllables = ["an", "the", "ti", "on", "er", "ou", "le", "ge", "ch", "st", "ñ", "é", "ü", "ra", "do", "in", "es", "ción", "ß", "k", "wh", "au", "m", "pa"]
    letters = "abcdefghijklmnopqrstuvwxyzxqjyzvABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def word() -> str:
        out = "".join(pick(syllables) for _ in range(r.randrange(1, 5))) if r.random() < 0.75 else "".join(pick(letters) for _ in range(r.randrange(1, 12)))
        return out.capitalize() if r.random() < 0.15 else out

    def plain() -> str:
        if r.random() < 0.5:
            return "".join(c for c in word() if c.isascii()) or "jo"
        return "".join(pick("bcdfghjklmnprstvwz") + pick("aeiouy") + pick(["", "", "n", "r", "s", "l"]) for _ in range(r.randrange(1, 4)))

    drawn = lambda alphabet, n: "".join(r.choices(alphabet, k=n))

    def card() -> str:
        d = pick(["4", "5", "6", "2", "37"])
        d += digits(15 - len(d))
        d += next(c for c in "0123456789" if luhn(d + c))
        a, b, c, e = d[:4], d[4:8], d[8:12], d[12:]
        return pick([d, f"{a} {b} {c} {e}", f"{a}-{b}-{c}-{e}", f"{a}.{b}.{c}.{e}", f"{a}.{b}.{c}.{e}", f"{a}/{b}/{c}/{e}", f"{a}_{b}_{c}_{e}"])

    def phone() -> str:
        a, b, c, land = digits(3), digits(3), digits(4), digits(2)
        return pick([f"+1 {a} {b} {c}", f"+1 ({a}) 555-{c}", f"+{land} {a} {digits(7)}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"00{land} {a} {digits(7)}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(2)} {digits(4)} {digits(4)}", f"(0{digits(2)}) {digits(3)} {digits(4)}", f"0{digits(3)}/{digits(7)}"])

    def email() -> str:
        user = pick(["", plain() + ".", plain() + "_"]) + plain() + pick(["", digits(2), "." + digits(2)])
        host, end = plain() + pick(["", digits(1)]), pick(["com", "org", "net", "de", "fr", "es", "io"])
        more = pick(["", "", ".example", "." + plain()])
        return pick([
            f"{user}@{host}{more}.{end}", f"{user}@{host}{more}.{end}", f"{user} (at) {host} (dot) {end}", f"{user}[at]{host}[dot]{end}", f"{user} [at] {host} [dot] {end}",
            f"{user}(at){host}(dot){end}", f"{user} at {host} dot {end}", f"{user} AT {host} DOT {end}", f"{user} @ {host}.{end}",
        ])

    def ip() -> str:
        parts = [str(r.randrange(256)) for _ in range(4)]
        six = [drawn("0123456789abcdef", r.randrange(1, 5)) for _ in range(8)]
        return pick([".".join(parts), "[.]".join(parts), "[.]".join(parts), "(.)".join(parts), " . ".join(parts), ":".join(six), ":".join(six), ":".join(six[:3]) + "::" + ":".join(six[3:5])])

    def secret() -> tuple[str, str, str]:
        key = pick(["token", "password", "secret", "api_key", "apikey", "access_key", "auth", "client_secret", "API_KEY", "passwd", "private_key"])
        if r.random() < 0.3:  # keys that show what they are
            return "", pick(["AKIA", "ASIA"]) + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) if r.random() < 0.6 else pick(["ghp_", "sk_live_", "pat-"]) + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 28), ""
        value = pick([drawn("0123456789abcdef", 40), drawn("0123456789abcdef", pick([32, 40, 64])), drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r.randrange(16, 49)), "sk_" + drawn("abcdefghijklmnopqrstuvwxyz0123456789", 24)])
        q = pick(['"', '"', "'", ""])
        return f"{key}{pick([' = ', ' = ', '=', ': ', ': ', ' := ', ' '])}{q}", value, q

    def other() -> str:
        return pick([
            digits(r.randrange(1, 8)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", "@" + word(), f"0x{digits(8)}",
            f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", drawn("0123456789abcdef", 40), f"id={drawn('0123456789abcdef', 32)}", f"{word()} at {word()}", f"{word()} (at) {word()}", f"{digits(3)},{digits(3)}", f"{digits(2)}%", f"${digits(3)}.{digits(2)}", f"the {word()} dot {word()}", digits(12), f"{digits(1)}, {digits(1)}, {digits(1)}",
        ])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        gap = pick([" ", " ", " ", " ", " ", " | ", "### ", "\n", ", "])
        again = [word() for _ in range(3)] if r.random() < 0.3 else []  # a text of few words, over and over
        run = lambda lo, hi: gap.join(pick(again) if again else word() for _ in range(r.randrange(lo, hi)))
        text, spans = run(0, 12), []
        for _ in range(r.randrange(1, 4)):
            kind = pick([*KINDS, "email", "phone", "secret", "secret", None, None])
            text += pick([gap, gap, gap, ": ", " (", "=", ". "]) if text else ""
            lead, piece, tail = ("", other(), "") if kind is None else secret() if kind == "secret" else ("", make[kind](), "")
            text += lead
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + tail + pick(["", "", "", ",", ".", ")", ";"]) + gap + run(0, 10)
        out.append((text, spans))
    return out


def training_windows(texts: list[tuple[str, list[Span]]], seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A window of each text, placed at random, so that it may begin and end within spans."""
    r = np.random.default_rng(seed)
    chars, tags = np.full((len(texts), WINDOW), PAD), np.zeros((len(texts), WINDOW), np.int64)
    for i, (text, spans) in enumerate(texts):
        c, t = codes(text), np.zeros(len(text), np.int64)
        for a, b, k in spans:
            t[a:b] = 1 + KINDS.index(k)
        at = int(r.integers(0, max(len(c) - WINDOW, 0) + 1))
        n = min(len(c), WINDOW)
        chars[i, :n], tags[i, :n] = c[at : at + n], t[at : at + n]
    return chars, tags


_trained: dict[tuple, Tagger] = {}


def trained(count: int = TRAINING, epochs: int = EPOCHS) -> Tagger:
    """The tagger of the generated spans; the same on every call."""
    if (count, epochs) not in _trained:
        _trained[count, epochs] = fit(*training_windows(labelled(count)), epochs=epochs)
    return _trained[count, epochs]


#: What spans have at least one of.
MARK = r"[0-9@]|(?i:[\x20\t\r\n\[({]dot[\x20\t\r\n\])}])|AKIA|ASIA"
_MARK = re.compile(MARK)


def windows(text: str, every: bool = False) -> list[int]:
    """Starts of the overlapping windows with a mark and of those that overlap them."""
    starts = np.arange(0, max(len(text) - STRIDE, 1), STRIDE)
    if every:
        return starts.tolist()
    marked = np.zeros(len(starts), bool)
    for m in _MARK.finditer(text):
        last = m.start() // STRIDE
        marked[max(last - 1, 0) : last + 1] = True
    near = marked.copy()
    near[1:] |= marked[:-1]
    near[:-1] |= marked[1:]
    return starts[near].tolist()


def reconciled(length: int, starts: list[int], tags: list[np.ndarray]) -> np.ndarray:
    """One tag for each character, from the window in which it is most central."""
    out, near = np.zeros(length, np.int8), np.full(length, -1, np.int64)
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for s, t in zip(starts, tags):
        n = min(WINDOW, length - s)
        inner = depth[:n].copy()
        if s == 0:
            inner[:STRIDE] = WINDOW
        better = inner > near[s : s + n]
        out[s : s + n][better] = t[:n][better]
        near[s : s + n][better] = inner[better]
    return out


AT = re.compile(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|\s*@\s*", re.I)
DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+", re.I)
DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[0-9]{2}|[0-9]{4})")
SECRET = re.compile(r"[A-Za-z0-9+/=_.-]{16,}")
#: An address with its at and dots spelled out, or set apart.
SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+(?:{AT.pattern})[A-Za-z0-9-]+(?:(?:{DOT.pattern}|\.)[A-Za-z0-9-]+)+", re.I)
#: What addresses look like as a whole, in any notation.
SHAPES = {"email": SPELLED, "ip": re.compile(r"[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}|(?<![\w:])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![\w:])")}
#: How far from what is tagged the rest of an address is looked for.
NEAR = 64
#: Characters over which a span of a kind goes on.
GOES_ON = {"email": LOCAL, "ip": re.compile("[0-9a-fA-F]"), "card": re.compile("[0-9]"), "phone": re.compile("[0-9+(]"), "secret": re.compile("[A-Za-z0-9+/=_-]")}


def sound(kind: str, s: str) -> bool:
    """Whether a text is of a kind by the kind's definition, in any notation."""
    d = len(_digits(s))
    if kind == "email":
        return EMAIL.fullmatch(AT.sub("@", DOT.sub(".", s))) is not None
    if kind == "ip":
        four = re.sub(r"\s*\.\s*", ".", DOT.sub(".", s))
        if IP.fullmatch(four):
            return all(map(octet, four.split(".")))
        try:
            return s.count(":") > 2 and ipaddress.ip_address(s).version == 6
        except ValueError:
            return False
    if kind == "card":
        return 14 <= d <= 19 and luhn(_digits(s)) and set(s) <= set("0123456789 -./_")
    if kind == "phone":
        return 9 <= d <= 15 and set(s) <= set("0123456789 -./()+") and any(c in s for c in "+ (-./") and not DATE.fullmatch(s)
    return SECRET.fullmatch(s) is not None and (0 < d < len(s) or s.startswith(("AKIA", "ASIA")))


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
    out: list[Span] = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if tags[a]:
            kind = KINDS[tags[a] - 1]
            more = GOES_ON[kind]
            # A tagged part of a number, address or value stands for all of it.
            while a and text[a - 1] != "=" and more.match(text[a - 1]):
                a -= 1
            while b < len(text) and more.match(text[b]):
                b += 1
            if kind in SHAPES:
                near = SHAPES[kind].finditer(text, max(a - NEAR, 0), min(b + NEAR, len(text)))
                a, b = next((m.span() for m in near if m.start() < b and a < m.end() and sound(kind, m[0])), (a, b))
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip(" ,;:=.|\"'")), b - (len(piece) - len(piece.rstrip(" ,;:=(.|\"'")))
            while kind == "phone" and text[a:b].startswith("(") and text.count("(", a, b) > text.count(")", a, b):
                a += 1
            if a < b and sound(kind, text[a:b]) and not (a and text[a - 1].isdigit()) and not (b < len(text) and text[b].isdigit()) and all(b <= x or y <= a for x, y, _ in base) and (not out or out[-1][1] <= a):
                out.append((a, b, kind))
    return out


def decoded(m: Tagger, texts: list[str], every: bool = False) -> list[np.ndarray]:
    """Tags of each text; every: windows without a mark are decoded too."""
    all_codes = [codes(t) for t in texts]
    starts = [windows(t, every) for t in texts]
    flat = [(i, s) for i, ss in enumerate(starts) for s in ss]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for at in range(0, len(flat), CHUNK):
        some = flat[at : at + CHUNK]
        block = np.full((len(some), WINDOW), PAD)
        for row, (i, s) in enumerate(some):
            c = all_codes[i][s : s + WINDOW]
            block[row, : len(c)] = c
        for (i, _), t in zip(some, viterbi(m, emissions(m, block))):
            found[i].append(t)
    return [reconciled(len(t), s, f) for t, s, f in zip(texts, starts, found)]


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, base, spans (base and added) and secrets, each written as kind:start:end by start, base counts, n_added, n_spans and n_secrets of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model or trained())
    kind = dict(docs.dtypes)["doc_id"]
    counts = [*(f"n_{k}" for k in BASE_KINDS), "n_added", "n_spans", "n_secrets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            hot = np.flatnonzero(pc.fill_null(pc.match_substring_regex(col, MARK), False)).tolist()
            texts = [col[i].as_py() for i in hot]
            base, spans, secrets = ([[] for _ in range(len(batch))] for _ in range(3))
            for i, text, tags in zip(hot, texts, decoded(sent.value, texts)):
                base[i] = base_spans(text)
                added = added_spans(text, tags, base[i])
                spans[i] = in_order(base[i] + [x for x in added if x[2] in BASE_KINDS])
                secrets[i] = in_order([x for x in added if x[2] not in BASE_KINDS])
            numbers = [*([sum(x[2] == k for x in b) for b in base] for k in BASE_KINDS), [len(x) - len(y) for x, y in zip(spans, base)], [len(x) for x in spans], [len(x) for x in secrets]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([written(x) for x in rows]) for rows in (base, spans, secrets)), *(pa.array(n, pa.int64()) for n in numbers)], ["doc_id", "base", "spans", "secrets", *counts])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base string, spans string, secrets string, {', '.join(c + ' long' for c in counts)}")
