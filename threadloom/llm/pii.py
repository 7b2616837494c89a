"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions that adds spans to them.

The tagger is trained in numpy on spans that the base patterns label in a bounded sample of texts, and on loosened
writings of those spans (no plus sign, other separators, blanks around the at sign). Whole texts are decoded in windows
that overlap; where windows meet, each character takes the tag of the window that it lies deeper in, so the tags of a text
are one sequence and a span may be longer than the overlap. Spans of that sequence that keep clear of base spans and look
like their kind (see ``plausible``) are added.

Edge cases: null and empty texts have no spans. Without any labelled span nothing is added. Repeated rows and null
doc_ids are handled row by row; extra columns are ignored. Texts of any length are scanned in linear time and decoded in
bounded batches of windows. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: From the first digit of a run only: where that one starts no chain, no later one does.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]")
#: Windows of training, and of decoding with their step.
WIDTH = 96
READ, STEP = 768, 720
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def emails(text: str):
    """Each at sign is looked at once: characters before it back to the last match, then the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        for m in DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                quad = parts[i : i + 4]
                end = at + sum(map(len, quad)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad):
                    found.append((at, 1, end))
                at = end + 1
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = NOT_DIGIT.sub("", m.group())
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    found.append((m.start(), kind, m.end()))
    return sorted(found)


def plausible(kind: int, value: str) -> bool:
    """What an added span must have besides the tagger's word."""
    digits = NOT_DIGIT.sub("", value)
    if kind == 0:
        return "@" in value.strip("@") and "." in value.partition("@")[2].strip(". ")
    if kind == 1:
        parts = [p for p in NOT_DIGIT.split(value) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def cuts_number(text: str, a: int, b: int) -> bool:
    """Whether a digit inside the span has a digit right outside."""
    digits = "0123456789"
    return (a > 0 and text[a - 1] in digits and text[a] in digits) or (b < len(text) and text[b] in digits and text[b - 1] in digits)


#: Printable ASCII has its own numbers; line feeds, other ASCII and all else share three more.
CODES = np.array([c - 31 if 32 <= c < 127 else 96 if c == 10 else 97 for c in range(128)] + [98], np.uint8)
#: Stands between pieces of text that are read in one row.
GAP = 99


def codes(text: str) -> np.ndarray:
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def snapped(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """An e-mail span's edges moved to those of the tokens on both sides of its at sign, over blanks beside it."""
    at = text.find("@", a, b)
    if kind or at < 0:
        return a, b
    left = at
    while left and text[left - 1] == " ":
        left -= 1
    while left and text[left - 1] in LOCAL:
        left -= 1
    right = at + 1
    while right < len(text) and text[right] == " ":
        right += 1
    domain = DOMAIN.match(text, right)
    return (left, domain.end()) if domain else (a, b)


class Tagger:
    VOCABULARY = 99

    def __init__(self, width: int = 12, hidden: int = 8, seed: int = 3):
        g = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"e": g.normal(0, 0.3, (self.VOCABULARY, width)), "u": g.normal(0, 0.3, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "t": g.normal(0, 0.1, (TAGS, TAGS))}
        for d in "fb":
            self.p[f"w{d}"] = g.normal(0, (width + hidden) ** -0.5, (width + hidden, 4 * hidden))
            self.p[f"b{d}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        #: A span's inside tags follow its first tag or themselves only.
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for inside in range(2, TAGS, 2):
            self.barred[[x for x in range(TAGS) if x not in (inside, inside - 1)], inside] = -1e4

    def _run(self, x: np.ndarray, d: str, kept: list | None):
        """x: (length, rows, width), in the direction of reading."""
        w, b, h = self.p[f"w{d}"], self.p[f"b{d}"], self.h
        state, cell, out = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape[:2], h), np.float32)
        split = x.shape[2]
        ahead = x @ w[:split] + b
        for i in range(len(x)):
            z = ahead[i] + state @ w[split:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = gates[:, :h] * before + gates[:, h : 2 * h] * new
            t = np.tanh(cell)
            state = gates[:, 2 * h :] * t
            out[i] = state
            if kept is not None:
                kept.append((prior, before, gates, new, t))
        return out

    def emissions(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """x: (rows, length) of codes; (length, rows, tags)."""
        e = self.p["e"][x.T]
        fk, bk = ([], []) if kept is not None else (None, None)
        states = np.concatenate([self._run(e, "f", fk), self._run(e[::-1], "b", bk)[::-1]], axis=2)
        if kept is not None:
            kept.update(e=e, f=fk, b=bk, states=states)
        return states @ self.p["u"] + self.p["c"]

    def read(self, x: np.ndarray) -> np.ndarray:
        """``emissions`` without what training keeps. Input weights are tabulated by code; both directions and all gates lie one
        after another in the same few buffers, so that each step is a dozen calls on whole arrays. The buffers hold exponents:
        1 / (1 + exp(z)) is a gate where z has its sign turned, and tanh where it is doubled too; the cell is kept as -2 times
        itself. At ``GAP`` the gates for what was before and for what is new are shut, so that both directions start anew."""
        h, (rows, length) = self.h, x.shape
        turned, table, inner = np.array([-1, -1, -1, -2], np.float32)[:, None, None], [], []
        for d in "fb":
            w = self.p[f"w{d}"]
            known = (self.p["e"] @ w[:-h] + self.p[f"b{d}"]).reshape(-1, 4, h).transpose(1, 0, 2) * turned
            gap = np.zeros((4, 1, h))
            gap[:2] = 1e4
            table.append(np.concatenate([known, gap], axis=1))
            inner.append(w[-h:].reshape(h, 4, h).transpose(1, 0, 2) * turned)
        table, inner = np.concatenate(table).reshape(-1, h).astype(np.float32), np.stack(inner).astype(np.float32)
        place, first = np.empty((2, 4, rows), np.int64), (np.arange(8) * (self.VOCABULARY + 1)).reshape(2, 4, 1)
        z, ahead, put = (np.empty((2, *shape, rows, h), np.float32) for shape in ((4,), (4,), ()))
        #: States in the order of reading, so that the backward direction's are turned at the end.
        state, cell, out = np.zeros((2, rows, h), np.float32), np.zeros((2, rows, h), np.float32), np.empty((2, length, rows, h), np.float32)
        by_step, (keep, let, show, new) = np.ascontiguousarray(x.T, np.int64), z.swapaxes(0, 1)
        with np.errstate(over="ignore"):
            for i in range(length):
                np.add(by_step[i], first[0], out=place[0])
                np.add(by_step[-1 - i], first[1], out=place[1])
                table.take(place, axis=0, out=ahead, mode="clip")
                np.matmul(state[:, None], inner, out=z)
                z += ahead
                np.exp(z, out=z)
                z += 1
                np.divide(-4, new, out=put)
                put += 2
                put /= let
                cell /= keep
                cell += put
                np.exp(cell, out=put)
                put += 1
                np.divide(2, put, out=put)
                put -= 1
                state = out[:, i]
                np.divide(put, show, out=state)
        by_tag, back = ((u.T @ o.reshape(-1, h).T).reshape(TAGS, length, rows) for u, o in zip((self.p["u"][:h], self.p["u"][h:]), out))
        by_tag += back[:, ::-1]
        by_tag += self.p["c"][:, None, None]
        return by_tag.transpose(1, 2, 0)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags (rows, length) of each piece between gaps, which are outside. A stretch of tags other than "outside" can
        only be in the best path if its leads over "outside", with the best of transitions added, sum to no less than zero; so
        only places in such stretches are searched, and what lies between them is outside."""
        em, t = self.read(x), self.p["t"] + self.barred
        length, rows = em.shape[:2]
        #: At a piece's ends neither path has a transition, so that the one into or out of a stretch counts as zero there.
        within, ends = float(t[1:, 1:].max() - t[0, 0]), sum(max(0.0, float(x.max() - t[0, 0])) for x in (t[0, 1:], t[1:, 0]))
        by_tag = em.transpose(2, 0, 1)
        lead = by_tag[1].copy()
        for tag in range(2, TAGS):
            np.maximum(lead, by_tag[tag], out=lead)
        lead += within - by_tag[0]
        lead[x.T == GAP] = -1e9
        both = np.stack([lead, lead[::-1]], axis=1)
        more = np.empty(both.shape[1:], both.dtype)
        for i in range(1, length):
            np.maximum(both[i - 1], 0, out=more)
            both[i] += more
        inside = np.zeros((rows, length + 2), np.int8)
        inside[:, 1:-1] = (both[:, 0] + both[::-1, 1] - lead >= within - ends - 1e-3).T
        out = np.zeros(x.shape, np.int64)
        edges = np.diff(inside, axis=1)
        (row, start), stop = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
        opens = (start == 0) | (x[row, start - 1] == GAP)
        closes = (stop == length) | (x[row, np.minimum(stop, length - 1)] == GAP)
        by = np.argsort(stop - start, kind="stable")
        for k in range(0, len(by), 512):
            some = by[k : k + 512]
            self._search(em, t, row[some], start[some], stop[some], opens[some], closes[some], out)
        return out

    @staticmethod
    def _search(em: np.ndarray, t: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, opens: np.ndarray, closes: np.ndarray, out: np.ndarray) -> None:
        """Viterbi over stretches with "outside" on both sides, or nothing where they open or close a piece."""
        most, n = int((stop - start).max()), len(row)
        score = em[start, row] + np.where(opens, 0, 1)[:, None] * t[0]
        score[:, 2::2] -= np.where(opens, 1e4, 0)[:, None]
        back = np.zeros((most, n, TAGS), np.int8)
        final = np.zeros(n, np.int64)
        closing = lambda s, at_end: (s + np.where(at_end, 0, 1)[:, None] * t[:, 0]).argmax(axis=1)
        ends = stop - start
        for i in range(most):
            if i:
                both = score[:, :, None] + t
                back[i] = both.argmax(axis=1)
                score = both.max(axis=1) + em[np.minimum(start + i, len(em) - 1), row]
            done = np.flatnonzero(ends == i + 1)
            final[done] = closing(score[done], closes[done])
        tag, each = final, np.arange(n)
        for i in range(most - 1, -1, -1):
            live = i < ends
            out[row[live], start[live] + i] = tag[live]
            tag = np.where(live & (i > 0), back[i, each, tag], tag)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the tags ``y`` (rows, length)."""
        kept: dict = {}
        em = self.emissions(x, kept)
        n, rows, t = len(em), np.arange(len(x)), self.p["t"]

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

        fw, bw = np.empty_like(em), np.zeros_like(em)
        fw[0] = em[0]
        for i in range(1, n):
            fw[i] = lse(fw[i - 1][:, :, None] + t, 1) + em[i]
        for i in range(n - 2, -1, -1):
            bw[i] = lse(t + (em[i + 1] + bw[i + 1])[:, None, :], 2)
        total = lse(fw[-1], 1)
        d_em = np.exp(fw + bw - total[:, None])
        pairs = np.exp(fw[:-1, :, :, None] + t + (em[1:] + bw[1:])[:, :, None, :] - total[:, None, None])
        d_t = pairs.sum(axis=(0, 1))
        np.subtract.at(d_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        for i in range(n):
            d_em[i, rows, y[:, i]] -= 1
        d_em /= len(x)
        g = {"t": d_t / len(x), "c": d_em.sum(axis=(0, 1)), "u": np.einsum("lnh,lnt->ht", kept["states"], d_em)}
        d_states = d_em @ self.p["u"].T
        d_e = self._back(kept["e"], kept["f"], d_states[:, :, : self.h], "f", g)
        d_e += self._back(kept["e"][::-1], kept["b"], d_states[::-1, :, self.h :], "b", g)[::-1]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.T.ravel(), d_e.reshape(-1, d_e.shape[2]))
        return g

    def _back(self, x, kept, d_out, d: str, g: dict) -> np.ndarray:
        w, h, split = self.p[f"w{d}"], self.h, x.shape[2]
        d_z = np.empty((*x.shape[:2], 4 * h), np.float32)
        d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for i in range(len(x) - 1, -1, -1):
            _, before, gates, new, t = kept[i]
            forget, put, show = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            ds = d_out[i] + d_state
            dc = d_cell + ds * show * (1 - t * t)
            z = d_z[i]
            z[:, :h] = dc * before * forget * (1 - forget)
            z[:, h : 2 * h] = dc * new * put * (1 - put)
            z[:, 2 * h : 3 * h] = ds * t * show * (1 - show)
            z[:, 3 * h :] = dc * put * (1 - new * new)
            d_cell = dc * forget
            d_state = z @ w[split:].T
        prior = np.stack([k[0] for k in kept])
        g[f"w{d}"] = np.concatenate([np.einsum("lni,lnj->ij", x, d_z), np.einsum("lni,lnj->ij", prior, d_z)])
        g[f"b{d}"] = d_z.sum(axis=(0, 1))
        return d_z @ w[:split].T

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.015, seed: int = 7) -> Tagger:
        """Adam over shuffled batches."""
        g0 = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(epochs):
            order = g0.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate / (1 + epoch / 3) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def loosened(kind: int, value: str, rng) -> str:
    """Another writing of the value that the base patterns miss."""
    if kind == 0:
        return value.replace("@", (" @ ", " @", "@ ")[rng.integers(3)])
    if kind == 1:
        return value.replace(".", (" . ", ". ", "-")[rng.integers(3)])
    if kind == 2:
        digits = NOT_DIGIT.sub("", value)
        return (".", "/", "_")[rng.integers(3)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return value.lstrip("+").replace("(", "").replace(")", "") if rng.integers(2) else re.sub(r"^\+[0-9]+ ?", "", value)


def varied(kind: int, value: str, rng) -> str:
    """The value with other digits and letters in the same places, still valid for its kind."""
    if kind == 1:
        return ".".join(str(rng.integers(256)) for _ in range(4))
    new = [str(rng.integers(10)) if c.isdigit() else chr(97 + rng.integers(26)) if kind == 0 and c.islower() else c for c in value]
    if kind == 2:
        last = max(i for i, c in enumerate(new) if c.isdigit())
        new[last] = next(d for d in "0123456789" if luhn(NOT_DIGIT.sub("", "".join([*new[:last], d]))))
    return "".join(new)


def snippets(text: str, most: int) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """At most ``most`` pieces (position of what it is about, piece, spans in the piece) of a text: about its digits and at
    signs, and, one in eight, about none."""
    found, out, done, k = base_spans(text), [], -1, 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        if len(out) >= most:
            break
        done = m.start() + WIDTH // 2
        start = max(0, m.start() - WIDTH)
        piece = text[start : m.start() + 2 * WIDTH]
        while k < len(found) and found[k][2] <= start:
            k += 1
        inside = []
        for a, kind, b in found[k:]:
            if a >= start + len(piece):
                break
            if a >= start and b <= start + len(piece):
                inside.append((a - start, kind, b - start))
        out.append((m.start() - start, piece, inside))
    plain = re.search(r"[^0-9@]{%d}" % (2 * WIDTH), text)
    if plain and len(text) % 8 == 0:
        out.append((WIDTH, plain.group(), []))
    return out


def training_windows(pieces: list, most: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Windows about the pieces' middles with their tags. Each labelled span is also shown in loosened writings, of itself and of
    values made from it; these are at most half of the windows."""
    rng, xs, ys = np.random.default_rng(seed), [], []

    def add(text: str, found, at: int) -> None:
        start = max(0, at - int(rng.integers(8, WIDTH - 8)))
        c = codes(text[start : start + WIDTH])
        x, y = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
        x[: len(c)] = c
        for a, kind, b in found:
            a, b = a - start, b - start
            if 0 <= a < WIDTH and b <= WIDTH:
                y[a:b] = 2 + 2 * kind
                y[a] = 1 + 2 * kind
        xs.append(x)
        ys.append(y)

    for at, text, found in pieces:
        if len(xs) >= most // 2:
            break
        add(text, found, at)
    spans = [(text, a, kind, b) for _, text, found in pieces for a, kind, b in found]
    shown = len(xs)
    for i in range(min(4 * len(spans), most - shown)):
        text, a, kind, b = spans[i % len(spans)]
        value = text[a:b] if i < len(spans) else varied(kind, text[a:b], rng)
        value = loosened(kind, value, rng)
        if plausible(kind, value):
            add(text[:a] + value + text[b:], [(a, kind, a + len(value))], a)
    return np.array(xs[:most]).reshape(-1, WIDTH), np.array(ys[:most]).reshape(-1, WIDTH)


def learn(docs: DataFrame, sample: int = 1000, per_text: int = 20, windows: int = 4000, epochs: int = 8) -> Tagger | None:
    """``sample`` bounds the texts, different ones with a digit or an at sign, first by a seeded hash; ``per_text`` the pieces
    of each (of less than 300 characters) that come to the driver; ``windows`` the training."""
    with_trigger = docs.select(F.col("text").alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    chosen = common.sampled_texts(with_trigger, sample, 23)

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = snippets(text, per_text)
                if rows:
                    spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for *_, s in rows], SNIPPET_SPANS)
                    columns = [pa.array([key] * len(rows), pa.int64()), pa.array([p for p, *_ in rows], pa.int64()), pa.array([x for _, x, _ in rows]), spans]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "piece", "spans"])

    got = chosen.mapInArrow(cut, "key long, at long, piece string, spans array<struct<start:long,kind:long,end:long>>").collect()
    pieces = [(r["at"], r.piece, [(s["start"], s["kind"], s["end"]) for s in r.spans]) for r in sorted(got, key=lambda r: (r.key, r["at"], r.piece))]
    x, y = training_windows(pieces, windows)
    return Tagger().train(x, y, epochs) if y.any() else None


SNIPPET_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))


def packed_rows(lengths: list[int], most: int) -> list[list[int]]:
    """The pieces dealt to about ``most`` rows or fewer, a gap after each: the longest first, to the fullest row that has room."""
    sizes = sorted(((n + 1, i) for i, n in enumerate(lengths)), key=lambda x: -x[0])
    room = sizes[0][0] * max(1, round(sum(n for n, _ in sizes) / (sizes[0][0] * most)))
    rows, left = [], []
    for n, i in sizes:
        k = bisect.bisect_left(left, (n,))
        free, r = left.pop(k) if k < len(left) else (room, len(rows))
        if r == len(rows):
            rows.append([])
        rows[r].append(i)
        bisect.insort(left, (free - n, r))
    return rows


def tag_sequences(tagger: Tagger, texts: list[str], batch: int = 512) -> list[np.ndarray]:
    """The tags of each text, from overlapping windows: a place between two windows' starts belongs to the one that it is
    further from the edge of. Windows lie one after another in ``batch`` rows, with gaps between, so that next to nothing is
    padding and no window's tags hang on the others."""
    out = [np.zeros(len(t), np.int64) for t in texts]
    edge = (READ - STEP) // 2
    coded = [codes(t) for t in texts]
    at = [(i, s) for i, t in enumerate(texts) for s in range(0, max(len(t) - READ + STEP, 1) if t else 0, STEP)]
    for k in range(0, len(at), 4 * batch):
        some = at[k : k + 4 * batch]
        lengths = [min(READ, len(texts[i]) - s) for i, s in some]
        rows = packed_rows(lengths, batch)
        x = np.full((len(rows), max(sum(lengths[j] + 1 for j in row) for row in rows) - 1), GAP, np.uint8)
        placed = []
        for r, row in enumerate(rows):
            a = 0
            for j in row:
                i, s = some[j]
                x[r, a : a + lengths[j]] = coded[i][s : s + READ]
                placed.append((i, s, r, a, lengths[j]))
                a += lengths[j] + 1
        tags = tagger.decode(x)
        tagged = tags.any(axis=1)
        for i, s, r, a, n in placed:
            if tagged[r]:
                lo, hi = edge if s else 0, n if s + READ >= len(texts[i]) else READ - edge
                out[i][s + lo : s + hi] = tags[r, a + lo : a + hi]
    return out


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of one kind's tags; a first tag opens a run, and so does a change of kind."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    inside = np.flatnonzero(tags > 0)
    if not len(inside):
        return []
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (kind[inside[1:]] != kind[inside[:-1]]) | (tags[inside[1:]] % 2 == 1)
    starts = inside[new]
    ends = np.append(inside[np.flatnonzero(new)[1:] - 1], inside[-1]) + 1
    return [(int(a), int(kind[a]), int(b)) for a, b in zip(starts, ends)]


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans, settled over the whole text: e-mail spans have their tokens' edges, and those stay that neither
    touch base spans or earlier ones nor cut a number, and look like their kind."""
    free, out = np.ones(len(text) + 1, bool), []
    for a, _, b in base:
        free[a:b] = False
    for a, kind, b in tagged_spans(tags):
        a, b = snapped(kind, text, a, b)
        if free[a:b].all() and not cuts_number(text, a, b) and plausible(kind, text[a:b]):
            out.append((a, kind, b))
            free[a:b] = False
    return out


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end in code points) for every row. ``options`` are those of ``learn``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("base", span), T.StructField("added", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def searched(batches):
        tagger = model.value
        for batch in batches:
            for rows, texts in common.texts_of(batch, limit=1 << 20):
                base = [base_spans(t) for t in texts]
                tags = tag_sequences(tagger, texts) if tagger is not None else [np.zeros(len(t), np.int64) for t in texts]
                added = [added_spans(*x) for x in zip(texts, tags, base)]
                lists = [pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans] for spans in column], kind) for column in (base, added)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(searched, schema)
