"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every byte with a distribution over languages, and
a document's probabilities are the mean of its letters' distributions. It is trained in numpy by backpropagation
through time (Adam) on every window of every labelled text of the training fold: the rows are dealt into rounds and
groups by a hash, each group of a round is learnt by a task that starts from the same network, and the next round starts
from the mean of their networks. Every window of every whole text is labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import ROW, ROW_ARROW, Scratch, arrow_map, batch, column, held_out, numbered, spare, without

WINDOW, HIDDEN = 48, 6
#: Rounds at most, and bytes of texts that a group has in a round (about; so the groups grow with the corpus, not what each learns).
ROUNDS, GROUP = 8, 2 << 20
#: Steps at least, of BATCH windows (first and most): small corpora get more passes. Rate of the first step.
STEPS, BATCH, RATE = 300, (256, 1024), 0.01
#: A language of fewer rows than this share of an even part is learnt in several groups, so that weights stay bounded.
RARE = 0.25
#: The pipeline rejects undetermined documents, and those with scores at which fewer than this share are right; buckets in
#: which that is counted.
PRECISION, BUCKETS = 0.5, 4096
#: Parameters are averaged as whole numbers of this part, so the mean doesn't depend on the order of tasks.
_UNIT = 1 << 24
#: Windows at a time, in training and in prediction (fewer with many languages; speed and memory only).
BLOCK, _BLOCK = 512, 1024
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: Letters among the characters up to U+FFFF; the rarer planes hold letters almost only, and signs that are taken out below.
_LETTER = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x10000)])


def letter_bytes(text: str, raw: bytes) -> np.ndarray:
    """Which bytes of a text in UTF-8 belong to letters: dashes, quotes, digits and pictographs don't."""
    if len(raw) == len(text):
        return _ASCII_LETTER[np.frombuffer(raw, np.uint8)]
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    for k in np.nonzero(code > 0xFFFF)[0]:
        letter[k] = chr(code[k]).isalpha()
    return np.repeat(letter, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))


def _inputs(wx: np.ndarray, ahead: np.ndarray, back: np.ndarray, out: np.ndarray) -> None:
    """What the bytes at a step of either direction add to the units: wx (3, 2, H, 256) gathered into out (6H, B)."""
    out = out.reshape(*wx.shape[:3], -1)
    for k in range(3):
        wx[k, 0].take(ahead, 1, out[k, 0], "clip")
        wx[k, 1].take(back, 1, out[k, 1], "clip")


class BiGru:
    """Parameters: for each direction wx (256, 3H), u (H, 3H), b (H); output wo (2H, K), bo (K). Gates in the order
    update, reset, new; the reset gate acts behind the recurrent product."""

    def __init__(self, p: dict[str, np.ndarray], languages: list[str]):
        self.p, self.languages, self.space = p, languages, None

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"wx{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"b{d}"] = np.zeros(hidden)
        p["wo"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        p["bo"] = np.zeros(len(languages))
        return cls({k: v.astype(np.float32) for k, v in p.items()}, languages)

    def _forward(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        wx, u, b = self.p[f"wx{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        hid, kept = len(b), []
        h = np.zeros((x.shape[1], hid), wx.dtype)
        out = np.empty((*x.shape, hid), wx.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = wx[x[t]], h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * hid] + g[:, : 2 * hid])))
            z, r, hn = zr[:, :hid], zr[:, hid:], g[:, 2 * hid :] + b
            n = np.tanh(a[:, 2 * hid :] + r * hn)
            kept.append((t, h, z, r, hn, n))
            h = n + z * (h - n)
            out[t] = h
        return out, kept

    def _both(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """wx (3, 2, H, 256), u (6H, 2H) and b (2H, 1) of both directions as one network of twice the units, gate by gate;
        halved for the gates, whose sigmoids are taken as tanh of half the sum."""
        hid, kind = len(self.p["bf"]), self.p["wo"].dtype
        half = np.concatenate([np.full(2 * hid, 0.5), np.ones(hid)]).astype(kind)
        wx = np.stack([(self.p[f"wx{d}"] * half).T.reshape(3, hid, 256) for d in "fb"], 1)
        u = np.zeros((3, 2, hid, 2, hid), kind)
        for k, d in enumerate("fb"):
            u[:, k, :, k] = (self.p[f"u{d}"] * half).T.reshape(3, hid, hid)
        return np.ascontiguousarray(wx), u.reshape(6 * hid, 2 * hid), np.concatenate([self.p["bf"], self.p["bb"]])[:, None]

    def _space(self, length: int, rows: int) -> tuple[np.ndarray, ...]:
        """Arrays that loss() fills for a block of windows; kept, because getting and returning memory costs as much as the
        sums do."""
        key = length, rows, self.p["wo"].dtype
        if self.space is None or self.space[0] != key:
            hid, k = len(self.p["bf"]), len(self.p["bo"])
            shapes = [(length, h * hid, rows) for h in (2, 6, 6, 2)] + [(length, k, rows)] * 2 + [(2 * hid, rows)] * 3
            self.space = key, (*(np.empty(z, key[2]) for z in shapes), np.empty((length, rows)))
        return self.space[1]

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over letters, and its gradients. x: (L, B) bytes, y: (B) classes, mask: (L, B) letters,
        weight: (B), of each window's letters. Windows are taken BLOCK at a time, which bounds what is kept of them."""
        share = (mask if weight is None else mask * weight).astype(self.p["wo"].dtype)
        share /= max(float(share.sum()), 1e-9)
        value, grad, both = 0.0, {k: np.zeros_like(w) for k, w in self.p.items()}, self._both()
        block = max(1, BLOCK * 64 // max(64, len(self.languages)))
        for k in range(0, x.shape[1], block):
            at = slice(k, k + block)
            value += self._block(np.ascontiguousarray(x[:, at], np.intp), y[at], share[:, at], both, grad)
        return value, grad

    def _block(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, both: tuple[np.ndarray, np.ndarray, np.ndarray], grad: dict[str, np.ndarray]) -> float:
        """The part of loss() that some windows give, added to grad. Both directions take a step at once, units in rows: the
        s-th is at byte s forwards and at byte L-1-s backwards."""
        p, hid, last = self.p, len(self.p["bf"]), len(x) - 1
        two, four = 2 * hid, 4 * hid
        wx, u, b = both
        out, gates, products, da, prob, own, rn, none, s, flat = self._space(*x.shape)
        none[:] = 0
        h = none
        for t in range(len(x)):
            a, g, new = gates[t], products[t], out[t]
            _inputs(wx, x[t], x[last - t], a)
            np.matmul(u, h, out=g)
            zr, n, hn = a[:four], a[four:], g[four:]
            zr += g[:four]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            hn += b
            np.multiply(hn, zr[two:], out=rn)
            n += rn
            np.tanh(n, out=n)
            np.subtract(h, n, out=new)
            new *= zr[:two]
            new += n
            h = new
        ahead, back = out[:, :hid], out[::-1, hid:]
        np.matmul(p["wo"][:hid].T, ahead, out=prob)  # (L, K, B)
        prob += np.matmul(p["wo"][hid:].T, back, out=own)
        prob += p["bo"][:, None]
        prob -= prob.max(1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= prob.sum(1, keepdims=True)
        truth = (np.arange(len(p["bo"]))[:, None] == y).astype(prob.dtype)  # (K, B)
        np.multiply(prob, truth, out=own)
        value = float(-(np.log(np.maximum(own.sum(1), 1e-12)) * share).sum())
        prob -= truth
        prob *= share[:, None, :]
        grad["wo"] += np.concatenate([np.matmul(z, prob.transpose(0, 2, 1)).sum(0) for z in (ahead, back)])
        grad["bo"] += prob.sum((0, 2))
        # da: first what the outputs say of the states, then the gradients of the new values before tanh
        np.matmul(p["wo"][:hid], prob, out=da[:, :hid])
        np.matmul(p["wo"][hid:], prob[::-1], out=da[:, hid:])
        whole = u.copy()
        whole[:four] *= 2
        whole, du, dh = np.ascontiguousarray(whole.T), np.zeros_like(u.T), rn
        dh[:] = 0
        for t in range(last, -1, -1):  # back through time
            before = out[t - 1] if t else none
            z, r, n = gates[t, :two], gates[t, two:four], gates[t, four:]
            g, dn = products[t], da[t]
            gz, gr, hn = g[:two], g[two:four], g[four:]
            dh += dn
            np.subtract(before, n, out=gz)
            gz *= z
            n *= n
            np.subtract(1, n, out=n)
            np.subtract(1, z, out=s)
            gz *= s
            gz *= dh
            s *= n
            np.multiply(dh, s, out=dn)
            np.subtract(1, r, out=s)
            s *= r
            s *= hn
            np.multiply(s, dn, out=gr)
            np.multiply(dn, r, out=hn)
            du += before @ g.T
            dh *= z
            dh += np.matmul(whole, g, out=s)
        du = du.reshape(2, hid, 3, 2, hid)
        for k, d in enumerate("fb"):
            at, mine = (x if d == "f" else x[::-1]).ravel(), slice(k * hid, (k + 1) * hid)
            for c in range(3 * hid):
                kind, unit = divmod(c, hid)
                flat[:] = (products[:, kind * two :] if kind < 2 else da)[:, k * hid + unit]
                grad[f"wx{d}"][:, c] += np.bincount(at, flat.ravel(), 256)
            grad[f"u{d}"] += du[k, :, :, k].reshape(hid, 3 * hid)
            grad[f"b{d}"] += products[:, four:][:, mine].sum((0, 2))
        return value

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray, passes: int = 1, size: int = BATCH[0], rates: tuple[float, float] = (RATE, 0.0), seed: int = 11) -> BiGru:
        """x and mask: (windows, L), y and weight: (windows); rates: of the first step and behind the last."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        total = passes * -(-len(x) // size)
        for _ in range(passes):
            order = rng.permutation(len(x))
            for k in range(0, len(x), size):
                part = order[k : k + size]
                _, grad = self.loss(x[part].T, y[part], mask[part].T, weight[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                lr = rates[0] + (rates[1] - rates[0]) * step / total
                step += 1
                for name, g in grad.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    self.p[name] -= lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def filled(self, values: np.ndarray) -> BiGru:
        """A network of this shape with the parameters of a flat()."""
        p, at = {}, 0
        for k in sorted(self.p):
            p[k] = values[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return BiGru(p, self.languages)

    def _states(self, x: np.ndarray) -> np.ndarray:
        """_forward() of both directions without what training keeps, as (2H, L, B): units in rows, so that every gate is
        contiguous."""
        wx, u, b = self._both()
        two, rows, last = len(b), x.shape[1], len(x) - 1
        hid, four = two // 2, 2 * two
        h, out = np.zeros((two, rows), np.float32), np.empty((two, *x.shape), np.float32)
        a, g = np.empty((6 * hid, rows), np.float32), np.empty((6 * hid, rows), np.float32)
        z, r, zr, n, gn = a[:two], a[two:four], a[:four], g[four:], a[four:]
        for t in range(len(x)):
            _inputs(wx, x[t], x[last - t], a)
            np.matmul(u, h, out=g)
            zr += g[:four]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n += b
            n *= r
            n += gn
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            out[:hid, t], out[hid:, last - t] = h[:hid], h[hid:]
        return out

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(K, L, windows): the distribution over languages at every byte."""
        x = np.ascontiguousarray(windows.T).astype(np.intp)
        wo = self.p["wo"]
        logits = np.ascontiguousarray(wo.T) @ self._states(x).reshape(len(wo), -1)
        logits += self.p["bo"][:, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(len(logits), *x.shape)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, K): mean over the letters of each whole text, zeros where there is none; and their letters'
        bytes."""
        said = [(t or "").encode("utf-8", "replace") for t in texts]
        counts = np.array([-(-len(r) // WINDOW) for r in said], np.int64)
        owner = np.repeat(np.arange(len(said)), counts)
        x = np.frombuffer(b"".join([r.ljust(c * WINDOW, b"\0") for r, c in zip(said, counts.tolist())]), np.uint8).reshape(-1, WINDOW)
        letter, at = np.zeros(x.size, bool), 0
        for t, r, c in zip(texts, said, counts.tolist()):
            if r:
                letter[at : at + len(r)] = letter_bytes(t, r)
            at += c * WINDOW
        letter = letter.reshape(-1, WINDOW)
        total, letters = np.zeros((len(said), len(self.languages))), np.zeros(len(said))
        block = max(1, _BLOCK * 64 // max(64, len(self.languages)))  # bounds positions() however many languages
        for k in range(0, len(x), block):
            mask = letter[k : k + block]
            sums = (self.positions(x[k : k + block]) * mask.T).sum(1)
            own = owner[k : k + block]
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(own, sums[c], len(said))
            letters += np.bincount(own, mask.sum(1), len(said))
        return total / np.maximum(letters, 1)[:, None], letters


def _windows(text: str) -> tuple[bytes, bytes]:
    """The windows of the whole text, and which of their bytes belong to letters."""
    raw = text.encode("utf-8", "replace")
    size = -(-len(raw) // WINDOW) * WINDOW
    return raw.ljust(size, b"\0"), letter_bytes(text, raw).tobytes().ljust(size, b"\0")


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, text, lang) of the labelled rows of the training fold."""
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    return rows.where((F.col("text") != "") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def _round(rows: DataFrame, net: BiGru, weights: dict[str, float], rounds: int, number: int) -> BiGru:
    """The mean of the networks that the groups of rows (group, key, lang, text) make of net, by their windows."""
    shared, out = rows.sparkSession.sparkContext.broadcast((net.p, net.languages, weights)), pa.schema([("at", pa.int32()), ("value", pa.int64())])
    rates = RATE * (1 - number / rounds), RATE * (1 - (number + 1) / rounds)

    def learnt(begun: BiGru, group: int, langs: list[str], parts: list[tuple[bytes, bytes]]) -> tuple[BiGru, int]:
        x, mask = (np.frombuffer(b"".join(p), np.uint8).reshape(-1, WINDOW) for p in zip(*parts))
        index = {g: k for k, g in enumerate(begun.languages)}
        n = np.array([len(p) // WINDOW for p, _ in parts])
        y, weight = np.repeat([index[g] for g in langs], n), np.repeat([shared.value[2][g] for g in langs], n)
        some = mask.any(1)  # others have no letter to learn from
        x, y, mask, weight = x[some], y[some], mask[some] > 0, weight[some]
        if not len(x):
            return begun, 0
        size = min(BATCH[1], max(BATCH[0], len(x) * rounds // STEPS))
        passes = -(-STEPS // (rounds * -(-len(x) // size)))
        return begun.train(x, y, mask, weight, passes, size, rates, seed=group), len(x)

    def run(batches):
        begun, total = BiGru(*shared.value[:2]), None
        at, net, langs, parts, size, seen = None, None, [], [], 0, 0

        def done():
            nonlocal total, net, seen, langs, parts, size
            if parts:
                net, n = learnt(net, at, langs, parts)
                seen, langs, parts, size = seen + n, [], [], 0

        def ended():
            nonlocal total
            done()
            if seen:
                value = np.append(np.rint(net.flat().astype(np.float64) * _UNIT).astype(np.int64) * seen, seen)
                total = value if total is None else total + value

        for b in batches:
            for group, g, t in zip(*(c.to_pylist() for c in b.columns)):
                if group != at:
                    ended()
                    at, net, seen = group, begun.filled(begun.flat()), 0
                parts.append(_windows(t))
                langs.append(g)
                size += len(parts[-1][0])
                if size > 4 * GROUP:  # a group of far more than it should have is learnt a part at a time
                    done()
        ended()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=out)

    mine = rows.where(F.col("group") % rounds == number)
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mine.repartition(groups, "group").sortWithinPartitions("group", "key", "lang", "text").select("group", "lang", "text")
    got = {r.at: r.value for r in arrow_map(dealt, run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    if not got:
        return net
    windows = got[len(got) - 1]
    return net.filled(np.array([got[k] / windows / _UNIT for k in range(len(got) - 1)]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """Learns from text and non-null lang of all rows of the training fold, each whole text; None where there are none.

    Languages weigh alike: a row's weight is the inverse of its language's rows, and rows of rare languages are learnt in
    several groups.
    """
    rows = _labelled(docs, id_col, text_col, lang_col)
    counts = sorted((r["lang"], r["n"], r["size"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).toLocalIterator())  # one a language, like the network's output
    if not counts:
        return None
    even = sum(n for _, n, _ in counts) / len(counts)
    copies = {g: max(1, int(np.ceil(RARE * even / n))) for g, n, _ in counts}
    size = sum(copies[g] * s for g, _, s in counts)
    rounds = int(min(ROUNDS, max(1, size // GROUP)))
    groups = rounds * max(1, round(size / (rounds * GROUP)))
    copies = {g: min(groups, c) for g, c in copies.items()}
    weights = {g: even / (n * copies[g]) for g, n, _ in counts}
    key = F.xxhash64("doc_id", "text")
    rare = [g for g, c in copies.items() if c > 1]
    rows = rows.withColumn("key", key)
    if rare:
        times = rows.sparkSession.createDataFrame([(g, copies[g]) for g in rare], "lang string, copies int")
        rows = rows.join(F.broadcast(times), "lang", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        group = F.pmod(F.pmod("key", F.lit(groups)) + F.col("copy") * F.expr(f"{groups} div copies"), F.lit(groups))  # no group has two copies of a row
    else:
        group = F.pmod("key", F.lit(groups))
    rows = rows.select(group.cast("int").alias("group"), "key", "lang", "text")
    net = BiGru.new([g for g, *_ in counts])
    for number in range(rounds):
        net = _round(rows, net, weights, rounds, number)
    return net


def _best(net: BiGru | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if net is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    prob, letters = net.documents(texts)
    best = prob.argmax(1)
    some = (letters > 0).tolist()
    names = [net.languages[k] if ok else "und" for k, ok in zip(best.tolist(), some)]
    return names, [min(1.0, float(prob[i, k])) if some[i] else 0.0 for i, k in enumerate(best.tolist())]


def predict(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row and whole text.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and all texts if nothing could be learnt.
    Null and repeated ids stay as rows; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.p, model.languages))
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        net = BiGru(*shared.value) if shared.value else None
        for b in batches:
            yield batch(out, b.column(0), *_best(net, b.column(1).to_pylist()))

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the training fold of docs and predicts every row."""
    return predict(docs, train(docs))


def least_score(scores: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The score up to which documents are best rejected: rejecting one gains precision and costs 1 if it was right
    (0 where nothing is gained)."""
    order = np.argsort(scores, kind="stable")
    gain = (precision - right[order]).cumsum()
    k = int(gain.argmax())
    return float(np.nextafter(scores[order][k], 2)) if gain[k] > 0 else 0.0


def calibrate(scored: DataFrame) -> float:
    """least_score() of all rows of scored (score double from 0 to 1, good boolean), exactly: sums by bucket of scores say
    in which buckets the best score can lie, only these are put in order, by Spark."""
    gain = F.when(F.col("good"), PRECISION - 1).otherwise(PRECISION)
    rows = scored.select("score", gain.alias("gain"), F.floor(F.col("score") * BUCKETS).cast("int").alias("bucket"))
    sums = sorted((r.bucket, r.gain, r.most) for r in rows.groupBy("bucket").agg(F.sum("gain").alias("gain"), F.sum(F.greatest("gain", F.lit(0.0))).alias("most")).collect())
    before = np.concatenate([[0.0], np.cumsum([g for _, g, _ in sums])])
    floor = before.max()
    open_ = [(b, float(before[k])) for k, (b, _, most) in enumerate(sums) if most and before[k] + most >= floor]
    if not open_:
        return 0.0
    spark = scored.sparkSession
    mine = rows.join(F.broadcast(spark.createDataFrame(open_, "bucket int, before double")), "bucket").groupBy("bucket", "score").agg(F.sum("gain").alias("gain"), F.first("before").alias("before"))
    upto = (F.col("before") + F.sum("gain").over(Window.partitionBy("bucket").orderBy("score"))).alias("upto")
    best = mine.select("score", upto).agg(F.max(F.struct("upto", (-F.col("score")).alias("low")))).first()[0]
    return float(np.nextafter(-best.low, 2)) if best.upto > 0 else 0.0


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language is undetermined, or whose score is one at which predictions are mostly wrong
    (see calibrate(); that is seen on all labelled rows of the training fold). Rows go by their place in the table, so
    repeated and null ids and equal rows each stay or go by their own text; all columns stay as they are."""
    scratch, row = Scratch(docs.sparkSession, "language"), spare(docs, "row")
    model, rows = train(docs, id_col, text_col, lang_col), numbered(docs, scratch, row)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.p, model.languages))
    out = pa.schema([("row", ROW_ARROW), ("score", pa.float64()), ("good", pa.bool_())])

    def score(batches):
        net = BiGru(*shared.value) if shared.value else None
        for b in batches:
            names, scores = _best(net, b.column(1).to_pylist())
            yield batch(out, b.column(0), [None if n == "und" else s for n, s in zip(names, scores)], [None if g is None else g == n for g, n in zip(b.column(2).to_pylist(), names)])

    label = F.when(~held_out(column(id_col)), column(lang_col).cast("string"))
    scored = arrow_map(rows.select(F.col(row).alias("row"), column(text_col).cast("string").alias("text"), label.alias("lang")), score, f"row {ROW}, score double, good boolean")
    scored = scratch.table(scored, "scored")
    least = calibrate(scored.where("score is not null and good is not null").select("score", "good"))
    gone = scored.where(F.col("score").isNull() | (F.col("score") < least))
    return without(rows, gone.select(F.col("row").alias(row)), row, scratch)
