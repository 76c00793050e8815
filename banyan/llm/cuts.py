"""Texts cut off by a field limit of their source or in mid-transfer.

Two kinds of evidence are combined into the odds that a text was cut.

(1) Lengths. Per source a mixture of log-normal distributions is fitted by maximum likelihood to the lengths of its distinct base texts (without
markers such as "… Xem thêm"); lengths with far more texts than the fitted density allows are its limits, and texts there are right-censored
in proportion to their excess, fit after fit until the limits stay. The censoring posterior of a text at a limit is the excess share,
sharpened by the endings of all texts at that limit; elsewhere the prior is the rate of cuts in mid-transfer.

(2) Endings. A text's ending falls into a cell: closed by signs, emoji, tags or links; an empty list item; an open sign; or a word (or a word and a blank), by
how often the whole corpus has the last two words in the midst of a sentence and at its end. How cut texts end is learned by cutting every text once
at a position drawn from its hash, which falls within a word, after a word or after a sign; cuts that fall at the end of a sentence are no
cases and are left out. How whole texts end follows from the texts off the limits, less the cuts among them: the share of each of the three kinds of cuts is
what the cells that whole texts avoid allow at most. No labels and no fitted constants enter. Corpus counts are aggregated and joined by the
words, never broadcast; what is collected has a row a cell.

Defined results: null, empty and blank texts are whole (cut = false, posterior 0); texts that lack a full stop, end
in tags, emoji, a link, a footer or an empty list item are judged by their cell; very long texts are used
whole; repeated texts get equal results; null sources form one source; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.llm.history import TAGS, fold
from banyan.session import durable

#: What writers and pages put after a text, and what sources put after a cut.
LAUGHS = ("huhu", "hihi", "haha", "hehe", "kkk")
FOOTERS = ("Chia sẻ | Lưu lại | Báo lỗi", "Bình luận (0)", "© Bản quyền thuộc về ban biên tập", "Xem thêm quán gần đây")
MARKERS = ("Xem thêm", "Đọc tiếp", "Read more")
#: Folded abbreviations that are written with a full stop in addresses.
ABBREVIATIONS = ("p", "d", "q", "tp", "ng", "tx", "tt", "h")
MARK = re.compile(rf"(?:…|\.\.\.)?\s*(?:(?:{'|'.join(MARKERS)})\s*)?$")
_alt = lambda xs: "|".join(re.escape(fold(x)) for x in xs)
DECOR = re.compile(
    rf"(?:https?://[^\s]*/[^\s]*|{_alt(FOOTERS)}|(?<!\w)(?:{_alt(MARKERS)})|[\s,.;!]*(?<!\w)(?:{_alt(TAGS)})|(?<!\w)(?:{'|'.join(LAUGHS)})|:[)(D]|[\s~!?.…\"'*|]|&\w+;|[^\w\s()\[\]{{}},:;/%-])+$"
)
ITEM = re.compile(r"(?:^|\n)\s*[-*•]\s*(?:\(\d(?:\.\d)?/\d\))?\s*$")
PROPER = re.compile(r"[.!?]\s+[^\W\d_a-zà-ỹ]")
WORDLIKE = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
SIGNS = re.compile(r"(\n|[^\w\s]+)")
THOUSANDS = re.compile(r"(?<=\d)[.,](?=\d)")
LAST = re.compile(r"(?:[.!?;]\s+|\n\s*)(\S+)\s*$")


def words(t: str) -> list[str]:
    return WORDLIKE.findall(DIGITS.sub("0", THOUSANDS.sub("", t)))


def _undecorated(s: str, window: int = 128) -> str:
    """s without the decoration at its end, which is sought from the end on, however long it is."""
    while True:
        end = s.rstrip()
        size = max(window, len(s) - max(end.rfind(" "), end.rfind("\n")) + 64)  # a link is one long word
        tail = s[-size:]
        n = DECOR.sub("", tail)
        if n or len(s) <= size:
            return s[: len(s) - len(tail)] + n
        s = s[: len(s) - len(tail)]


def core(folded: str) -> tuple[str, bool]:
    """The folded text before its decoration, and whether an empty list item ended it."""
    s = folded
    while True:
        line = s.rfind("\n", 0, len(s.rstrip())) if s.rstrip() else -1
        item = ITEM.search(s, max(0, line))
        if item and item.end() > item.start() and s[item.start() :].strip():
            return s[: item.start()], True
        n = _undecorated(s)
        if n == s:
            return s, False
        s = n


def base_length(text: str) -> int:
    """Characters of the text before a marker of a cut; all where there is none."""
    at = max(0, len(text.rstrip()) - 32)
    m = MARK.search(text, at)
    return m.start() if m.group().strip() else len(text)


def count_contexts(folded: str, proper: bool, mid: Counter, end: Counter) -> None:
    """Adds (word before, word) of each word in the midst of a sentence and before its end; a word that nothing follows counts nowhere.

    `proper` texts write sentences with stops and capitals, so a word before a comma is in the midst of one.
    """
    parts = SIGNS.split(DIGITS.sub("0", THOUSANDS.sub("", folded)).replace("_", " "))
    for i in range(0, len(parts), 2):
        w = parts[i].split()
        if not w:
            continue
        mid.update(zip(["", *w], w[:-1]))
        sign = parts[i + 1] if i + 1 < len(parts) else ""
        last = (w[-2] if len(w) > 1 else "", w[-1])
        if not sign or "…" in sign or "..." in sign:  # may stand for a cut
            continue
        if sign[0] in ".!?;\n":
            if not (sign == "." and w[-1] in ABBREVIATIONS):
                end[last] += 1
        elif proper and sign[0] == ",":
            mid[last] += 1


def ending(text: str, folded: str) -> tuple[int, str, str, str]:
    """(length of the base text, state, word before, last word); the state is closed, item, open, word or spaced. Both texts have equal positions."""
    n = base_length(text)
    body, item = core(folded)
    tail = body[-200:]
    last = words(tail)[-2:]
    if "�" in text[-8:]:
        state = "open"
    elif not last:
        state = "closed"
    elif item:
        state = "item"
    else:
        after = folded[len(body) : n].strip()
        if body.rstrip()[-1:] in (",", "(", "[", "{", "-", "*") and not after:
            state = "open"
        elif after and not (set(after) <= {".", "…"} and (len(after) != 1 or body[-1:].isdigit())):
            state = "closed"
        else:
            state = "spaced" if text[n - 1].isspace() else "word"
    stop = LAST.search(tail)
    if stop and len(last) == 2 and len(words(stop.group(1))) == 1:
        last = ["", last[1]]
    return n, state, last[-2] if len(last) > 1 else "", last[-1] if last else ""


#: kind: 0 counts of words, 1 the ending of a text, and that of a text cut by us: 2 within a word, 3 after a word, 4 after a sign.
OURS = (2, 3, 4)
_PASS = "kind int, key {key}, source string, base int, same bigint, state string, w1 string, w2 string, mid bigint, end bigint"


def read_texts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """All that is drawn from the texts, in one pass over them."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        mid: Counter = Counter()
        end: Counter = Counter()

        def counts() -> pa.RecordBatch:
            k = list(mid.keys() | end.keys())
            n = len(k)
            none = lambda t: pa.nulls(n, t)
            cols = [pa.array(np.zeros(n, np.int32)), none(schema), none(pa.string()), none(pa.int32()), none(pa.int64()), none(pa.string())]
            cols += [pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()), pa.array([mid[x] for x in k], pa.int64()), pa.array([end[x] for x in k], pa.int64())]
            mid.clear()
            end.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        names = ["kind", "key", "source", "base", "same", "state", "w1", "w2", "mid", "end"]
        for b in batches:
            schema = b.column("key").type
            out: list[tuple] = []
            at: list[int] = []
            for i, t in enumerate(b.column("__text").to_pylist()):
                if not t or not t.strip():
                    out.append((1, 0, None, "", "", ""))
                    at.append(i)
                    continue
                t = unicodedata.normalize("NFC", t)
                f = fold(t)
                count_contexts(f, bool(PROPER.search(t)), mid, end)
                same = zlib.crc32(t.encode("utf-8", "replace"))
                n, *rest = ending(t, f)
                out.append((1, n, same, *rest))
                at.append(i)
                cut = n // 4 + same % (n - n // 4) if n >= 8 else 0
                if cut and f[cut:].lstrip()[:1] not in ".!?;…" and "\n" not in f[cut : cut + 2]:
                    rest = ending(t[:cut], f[:cut])[1:]
                    if rest[0] not in ("closed", "item"):  # else it falls at the end of a sentence or an item
                        before = f[cut - 1]
                        out.append((4 if rest[0] == "open" else 2 if before.isalnum() and f[cut : cut + 1].isalnum() else 3, cut, same, *rest))
                        at.append(i)
            n = len(out)
            c = list(zip(*out)) if out else [[]] * 6
            take = pa.array(at, pa.int64())
            cols = [pa.array(c[0], pa.int32()), b.column("key").take(take), b.column("source").take(take), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), *(pa.array(x, pa.string()) for x in c[3:]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)
            if len(mid) + len(end) > 200_000:
                yield counts()
        if mid or end:
            yield counts()

    return df.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("__text")).mapInArrow(run, _PASS.format(key=kind))


# --- lengths ---


def fit_mixture(x: np.ndarray, count: np.ndarray, censored: np.ndarray, k: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, means, deviations, log-likelihood) of log lengths x; the share `censored` of the texts at x is known to be longer only."""
    n = count.sum()
    order = np.cumsum(count) / n
    mu = x[np.searchsorted(order, (np.arange(k) + 0.5) / k).clip(0, len(x) - 1)].astype(float)
    sd = np.full(k, max(0.1, math.sqrt(np.average((x - np.average(x, weights=count)) ** 2, weights=count)) / k))
    w = np.full(k, 1 / k)
    erfc = np.vectorize(math.erfc, otypes=[float])
    at = np.flatnonzero(censored)
    y, many, known = x[at][:, None], (count * censored)[at], count * (1 - censored)
    like, new = -math.inf, -math.inf
    for _ in range(rounds):
        z = (x[:, None] - mu) / sd
        pdf = w * np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))
        total = pdf.sum(1) + 1e-300
        r = pdf * (known / total)[:, None]
        new = float((known * np.log(total)).sum())
        weight, s1, s2 = r.sum(0) + 1e-9, (r * x[:, None]).sum(0), (r * x[:, None] ** 2).sum(0)
        if len(at):  # a censored length stands for the mean and the square above it
            a = (y - mu) / sd
            tail = np.maximum(1e-300, erfc(a / math.sqrt(2)) / 2)
            over = (w * tail).sum(1) + 1e-300
            s = w * tail * (many / over)[:, None]
            h = np.minimum(np.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail, np.abs(a) + 2)
            m1 = mu + sd * h
            m2 = sd * sd * np.maximum(1e-6, 1 + a * h - h * h) + m1 * m1
            new += float((many * np.log(over)).sum())
            weight, s1, s2 = weight + s.sum(0), s1 + (s * m1).sum(0), s2 + (s * m2).sum(0)
        mu = s1 / weight
        sd = np.sqrt(np.maximum(0.05**2, s2 / weight - mu * mu))
        w = weight / weight.sum()
        if abs(new - like) < 1e-6 * abs(new):
            break
        like = new
    return w, mu, sd, new


def fit_source(n: np.ndarray, count: np.ndarray, parts: int = 6, chance: float = 1e-4) -> dict[int, float]:
    """The censoring posterior of each limit of a source, from its lengths and their counts.

    A limit is a length whose count has a chance below `chance` (over all lengths) under the fitted density and is more than twice what is expected.
    The number of components is that with the least Bayesian information criterion.
    """
    keep = n > 0
    order = np.argsort(n[keep])
    n, count = n[keep][order].astype(float), count[keep][order].astype(float)
    if not len(n):
        return {}
    x, censored, limits = np.log(n), np.zeros(len(n)), None
    for _ in range(12):
        best = None
        for k in range(1, min(parts, len(n)) + 1):
            fit = fit_mixture(x, count, censored, k)
            bic = -2 * fit[3] + (3 * k - 1) * math.log(count.sum())
            if best is None or bic < best[0]:
                best = (bic, fit)
        w, mu, sd, _ = best[1]
        z = (x[:, None] - mu) / sd
        # where censoring ends the counts, longer texts are missing: the density holds for all texts
        expected = np.maximum(1e-9, count.sum() * (w * np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))).sum(1) / n)
        excess = np.maximum(0.0, 1 - expected / count)
        unlikely = np.where(count > expected, count * np.log(count / expected) - count + expected, 0.0)  # the Chernoff bound of a Poisson count
        hit = (unlikely > math.log(len(n) / chance)) & (excess > 0.5) & (count >= 3)
        censored = np.where(hit, excess, 0.0)
        now = tuple(np.flatnonzero(hit))
        if now == limits:
            break
        limits = now
    return {int(n[i]): float(censored[i]) for i in limits}


def length_limits(ends: DataFrame) -> DataFrame:
    """(source, base, prior): the censoring posterior at each limit of a source; equal texts count once."""
    hist = ends.filter("base > 0").select("source", "base", "same").distinct().groupBy("source", "base").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        post = fit_source(pdf["base"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"source": pd.Series([str(pdf["source"].iloc[0])] * len(post), dtype=object), "base": pd.Series(list(post), dtype="int32"), "prior": pd.Series(list(post.values()), dtype="float64")})

    # a group has a row for each length, not for each text
    return hist.groupBy("source").applyInPandas(fit, "source string, base int, prior double")


# --- endings ---

LIMIT_WEIGHT = 10.0
EDGES = (-3, -1, 0, 1)


def _bin(llr: Column) -> Column:
    return sum(((llr > e).cast("int") for e in EDGES), F.lit(0))


def cells(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """`ends` with the cell of each ending: its state, and for words whether the corpus has them in the midst of sentences or at their end."""
    totals = counts.agg(F.coalesce(F.sum("mid"), F.lit(0)).alias("__m"), F.coalesce(F.sum("end"), F.lit(0)).alias("__e"))  # one row
    single = counts.groupBy("w2").agg(F.sum("mid").alias("mid1"), F.sum("end").alias("end1"))
    e = ends.join(counts, ["w1", "w2"], "left").join(single, "w2", "left").crossJoin(F.broadcast(totals))
    e = e.fillna(0, ["mid", "end", "mid1", "end1"])
    llr = lambda a, b: F.log((F.col(a) + 0.5) / (F.col("__m") + 1)) - F.log((F.col(b) + 0.5) / (F.col("__e") + 1))
    seen = F.when(F.col("mid") + F.col("end") > 0, F.concat(F.lit(" pair "), _bin(llr("mid", "end")).cast("string"))).when(F.col("mid1") + F.col("end1") == 0, F.lit(" new")).otherwise(F.concat(F.lit(" word "), (_bin(llr("mid1", "end1")) / 2).cast("int").cast("string")))
    cell = F.when(F.col("state") == "word", F.concat("state", seen)).otherwise(F.col("state"))
    return e.withColumn("cell", cell).drop("mid", "end", "mid1", "end1", "__m", "__e", "w1", "w2")


def learn_cells(texts: dict[str, float], ours: list[dict[str, float]]) -> tuple[dict[str, float], dict[str, float], float]:
    """(cell -> odds of a cut off the limits, cell -> likelihood ratio of a cut at a random position, the share of cuts off the limits).

    From the counts of endings of texts off the limits, and of texts cut by us in several kinds. Whole texts avoid some cells of each kind,
    so the texts bound its share: the cells with the least texts for our cuts, up to half of a kind's cuts, give it.
    """
    names = sorted(set(texts).union(*ours))
    seen = np.array([texts.get(x, 0.0) for x in names])
    cut = np.array([[c.get(x, 0.0) for x in names] for c in ours])
    if not seen.sum() or not cut.sum():
        return {}, {}, 0.0
    obs = (seen + 0.1) / (seen + 0.1).sum()
    shares, cuts = [], np.zeros(len(names))
    for c in cut:
        if not c.sum():
            continue
        a = c / c.sum()
        order = np.argsort(obs / np.maximum(a, 1e-12))
        upto = order[: np.searchsorted(np.cumsum(a[order]), 0.5) + 1]
        shares.append(float(min(0.5, obs[upto].sum() / a[upto].sum())))
        cuts += shares[-1] * a
    # a cell in which cuts explain all texts may hold whole ones by the error of its count
    whole = np.maximum(obs - cuts, np.minimum(obs, 0.5 * np.sqrt(seen + 0.25) / seen.sum()))
    random = cut.sum(0) / cut.sum()
    return dict(zip(names, (cuts / whole).tolist())), dict(zip(names, (random / whole).tolist())), float(sum(shares))


def detect_cuts(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, at_limit, posterior, cut) of each row."""
    read = durable(read_texts(df, key, source, text))
    counts = read.filter("kind = 0").groupBy("w1", "w2").agg(F.sum("mid").alias("mid"), F.sum("end").alias("end"))
    ends = read.filter("kind > 0").drop("mid", "end")
    limits = length_limits(ends.filter("kind = 1"))
    e = durable(cells(ends, counts).join(limits, ["source", "base"], "left"))
    # a row a cell
    c = e.filter("base > 0 and (kind > 1 or prior is null)").groupBy("kind", "cell").agg(F.count("*").alias("n")).collect()
    odds, ratio, _ = learn_cells(*(lambda x: (x[0], x[1:]))([{r["cell"]: float(r["n"]) for r in c if r["kind"] == k} for k in (1, *OURS)]))

    def of(known: dict[str, float]) -> Column:
        m = F.create_map(*(F.lit(v) for x in sorted(known.items()) for v in x)) if known else F.create_map().cast("map<string,double>")
        return F.coalesce(F.try_element_at(m, F.col("cell")), F.lit(0.0))

    d = e.filter("kind = 1").withColumns({"lr": of(ratio), "odds": of(odds)})

    def sharpen(pdf: pd.DataFrame) -> pd.DataFrame:
        """The share of cut texts at a limit: the censoring posterior, worth `LIMIT_WEIGHT` texts, and the endings there."""
        start, lr, n = float(pdf["prior"].iloc[0]), pdf["lr"].to_numpy(float), pdf["n"].to_numpy(float)
        q = start
        for _ in range(200):
            p = q * lr / (q * lr + 1 - q)
            new = ((p * n).sum() + LIMIT_WEIGHT * start) / (n.sum() + LIMIT_WEIGHT)
            if abs(new - q) < 1e-9:
                break
            q = new
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "base": pdf["base"].iloc[:1].astype("int32").to_numpy(), "q": [q]})

    # a group has a row a cell
    at = d.filter("prior is not null").groupBy("source", "base", "prior", "cell", "lr").agg(F.count("*").alias("n"))
    at = at.groupBy("source", "base").applyInPandas(sharpen, "source string, base int, q double")
    d = d.join(at, ["source", "base"], "left")
    # a text at a limit may have been cut in mid-transfer as well
    total = F.col("odds") + F.coalesce(F.col("q") / (1 - F.least("q", F.lit(1 - 1e-9))) * F.col("lr"), F.lit(0.0))
    posterior = F.when(F.col("base") > 0, total / (1 + total)).otherwise(0.0)
    return d.select("key", "source", F.col("prior").isNotNull().alias("at_limit"), posterior.alias("posterior"), (posterior > 0.5).alias("cut"))


def cut_rates(found: DataFrame) -> DataFrame:
    """How often each source cuts."""
    return found.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"), F.round(F.count_if("cut") / F.count("*"), 6).alias("rate"))
