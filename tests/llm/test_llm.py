import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from banyan.llm import addresses, cuts, entities, history, mixing, queries, survivors, tokens

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1: addresses ---

SAME = [
    "Số 226B Ngách 69, Ngõ 230, Phố Sa Khê Bích, P. Xuyên Xuyên, Q.Trầm Hạ, TP. Dương Lưu",
    "226B ngách 69 ngõ 230 Sa Khê Bích, quận Trầm Hạ",
    "226B Ng. 230/69 Đ. Sa Khê Bích (đối diện cổng chợ), Phường Xuyên Xuyên, Trầm Hạ, Dương Lưu 11100, Việt Nam",
    "230/69/226B Đường Sa Khê Bích, Q. Trầm Hạ",
    "TP. Dương Lưu - Q. Trầm Hạ - P. Xuyên Xuyên - Tầng 2 - Số 226B Ngách 69, Ngõ 230, Sa Khê Bích",
    "So 226B Ngach 69, Ngo 230, Duong Sa Khe Bich, Quan Tram Ha",
]


def key(a):
    g = addresses.parse_address(a)
    return g and (g["street"], g["alleys"], g["house"])


@pytest.mark.parametrize("a", SAME)
def test_address_forms(a):
    assert key(a) == ("sa khe bich", "230/69", "226b")


def test_address_details():
    assert key("Lô B2, 24 Tùng Phong Trà, P.Chi Phúc") == ("tung phong tra", "", "24")
    assert key("Ngõ 166, P. Thiên Loan Trầm, P.Hạ Thạch, số 107, Dương Lưu") == ("thien loan tram", "166", "107")
    assert key("162 Dương Đoan Thạch, Nam Thủy") == ("duong doan thach", "", "162")
    assert key("T1 57 ngõ 197, lộc đoan tân, tân song 10550, việt nam") == ("loc doan tan", "197", "57")
    for bad in (None, "", "n/a", "Hà Nội", "Số 5", "x" * 100_000):
        assert key(bad) is None


def recs(spark, data):
    return spark.createDataFrame(data, "rec string, store_id string, text string, own string")


def test_same_house(spark):
    base = [(f"s{i}", f"b{i}", f"{i} Sa Khê Bích, Q. Trầm Hạ", "Trầm Hạ") for i in range(30, 40)]
    data = base + [
        ("a1", "1", SAME[0], "Trầm Hạ"), ("l2", "2", SAME[2], "Trầm Hạ"), ("g3", "3", SAME[3].replace("Khê", "Khêê"), None), ("a4", "1", SAME[1], "Trầm Hạ"),
        ("a5", "5", "226 Ng. 230/69 Sa Khê Bích, Q. Trầm Hạ", "Trầm Hạ"), ("a6", "6", "230/69/226B Sa Khê Bích, Q. Viên Xuyên", "Viên Xuyên"), ("a7", "7", "230/69/226B Sa Khê Bích, Q. Viên Xuyên", None),
        ("a8", "8", None, None), ("s9", "9", "226B ngách 69 ngõ 230 Sa Khê Bích", "Trầm Hạ"),
    ]
    got = rows(addresses.same_house(recs(spark, data)))
    one = ["a1", "a4", "g3", "l2", "s9"]
    want = sorted((a, b) for i, a in enumerate(sorted(one)) for b in sorted(one)[i + 1 :] if {a, b} != {"a1", "a4"}) + [("a6", "a7")]
    assert got == sorted(want)
    assert rows(addresses.same_house(recs(spark, []))) == []


# --- 2: survivors ---


def test_dominating_rows_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    data = []
    for i in range(160):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(30)}"
        data.append((i, g, rng.choice(["Foody", "foody hust places", "gmaps", None]), rng.choice([None, "x", "n/a", "y"]), rng.choice([None, "z", " "]), rng.choice(["high", " Cao ", "med", "thấp", None, "?"]), dt.datetime(2025, 1, 1 + rng.randrange(5))))
    df = spark.createDataFrame(data, "map_id long, store_id string, source_name string, a string, b string, match_confidence string, crawled_at timestamp")
    trust = {"high": 3, "cao": 3, "med": 2, "thấp": 1}
    groups = {}
    for i, g, s, a, b, c, t in data:
        if s is None:
            continue
        v = (trust.get((c or "").strip().lower(), 0), (a in ("x", "y")) + (b == "z"), t)
        groups.setdefault((g, "f" if s[0] in "Ff" else "g"), []).append((i, v))
    want = {i for r in groups.values() if len(r) > 1 for i, v in r if all(j == i or (all(x >= y for x, y in zip(v, w)) and v != w) for j, w in r)}
    g = survivors.source_groups(df)
    out = survivors.representatives(g).collect()
    assert {r["row_key"] for r in out if r["dominates"]} == want and len(out) == len(groups)
    assert survivors.representatives(survivors.source_groups(df.filter("false"))).count() == 0
    # without what the model infers, other rows represent the groups and cases are lost
    monkeypatch.setattr(survivors, "posterior", lambda stated, prior, out="p": stated.withColumn(out, F.lit(0.5)))
    assert {r["row_key"] for r in survivors.representatives(g).collect() if r["dominates"]} < want


def test_model_learns_the_judges():
    """Of two judges that disagree the one that mostly agrees with the third holds."""
    yes, no, n = np.array([7, 0, 5, 2, 6, 1]), np.array([0, 7, 2, 5, 1, 6]), np.array([50.0, 50, 30, 30, 3, 3])
    q = survivors.infer(yes, no, n, np.full(3, 0.8))
    assert q.p[0] > q.p[2] > q.p[4] > q.p[3] > q.p[1] and q.sens[2] > q.sens[1] and 2 < q.rounds < 2000
    assert survivors.infer(yes[:0], no[:0], n[:0], np.full(3, 0.8)).p.size == 0


def test_truths_trust_the_better_source(spark):
    data = []
    for g in range(60):
        data += [(g, "c", "good", 0), (g, "c", "good", 1), (g, "c", "good" if g % 10 else "bad", 2), (g, "c", "bad", 3)]
    df = spark.createDataFrame(data, "grp long, col string, val string, src int").withColumns({"trust": F.col("src") % 4, "at": F.lit(None).cast("timestamp")})
    p = {(r["grp"], r["val"]): r["p"] for r in survivors.truths(df, ["grp"], np.full(4, 0.75)).collect()}
    assert p[1, "good"] > 0.9 and p[1, "bad"] < 0.1 and p[10, "good"] > p[10, "bad"]


def test_fused_records(spark):
    """Field by field: what several sources state, with all values judged true kept; a value that one poor row states against others is not."""
    t = lambda d: dt.datetime(2025, 1, d)
    data = [(10 * g + i, f"g{g}", "foody", a, b, c, t(1 + i)) for g in range(40) for i, (a, b, c) in enumerate([("x", None, "high"), ("x", "p", "medium"), ("x", "p", "high"), ("bad", "p", "low")])]
    data += [(900, "both", "foody", "v1", None, "high", t(1)), (901, "both", "foody", "v2", " ", "high", t(2)), (902, None, "foody", "v", "w", "high", t(1)), (903, "blank", "foody", "n/a", None, None, None)]
    df = spark.createDataFrame(data, "map_id long, store_id string, source_name string, a string, `b c` string, match_confidence string, crawled_at timestamp")
    g = survivors.source_groups(df.withColumnRenamed("b c", "b"))
    out = {r["store_id"]: r for r in survivors.fused(g).collect()}
    assert set(out) == {f"g{i}" for i in range(40)} | {"both", "blank"}
    assert out["g3"]["row_key"] in (32, 33) and out["g3"]["dominates"] is False and {k: out["g3"]["record"][k] for k in "ab"} == {"a": "x", "b": "p"}
    assert out["both"]["record"]["a"] == "v2" and "a" not in out["blank"]["record"]
    kept = {(r["store_id"], r["val"]): r["best"] for r in survivors.values(g).collect() if r["col"] == "a"}
    assert kept["g3", "x"] and ("g3", "bad") not in kept
    assert kept["both", "v2"] and kept.get(("both", "v1")) is False
    assert survivors.fused(survivors.source_groups(df.withColumnRenamed("b c", "b").filter("false"))).count() == 0


# --- 4: history ---


def review(i, batch, name, text, store="s"):
    return (i, batch, store, name, text)


LONG = "Mình gọi trà vải hoa hồng giá 136k mà phần chỉ đủ 51 miếng, nếu bỏ bớt đá viên thì bún đậu mắm tôm sẽ tạm được hơn nhiều"


def test_history(spark):
    data = [
        review(1, 0, None, LONG), review(2, 0, "Gạo", "Ngon tuyệt, Nhạt vị, Gói hàng kỹ, Hợp túi tiền, Thiếu món"), review(3, 0, None, None), review(4, 0, None, "Ngon tuyệt, Nhạt vị, Gói hàng kỹ, Hợp túi tiền, Thiếu món"),
        review(5, 1, "Mít Lười 12", history.fold(LONG).upper() + ", Ngon tuyệt"), review(6, 1, "M***12", LONG.replace("gọi", "goị") + "… Xem thêm"), review(7, 2, None, LONG, "other"),
        review(8, 2, None, LONG.replace("136k", "99k").replace("51", "7").replace("bún đậu mắm tôm", "phở cuốn").replace("trà vải hoa hồng", "kem bơ")), review(9, 2, "  ", "Review: " + LONG), review(10, 3, "Ong", "ngắn"),
    ]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    got = rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4))
    assert got == [(1, 5), (1, 6), (1, 9)]
    assert rows(history.repeated_rows(df.filter("false"), "i", "b", "s", "n", "t", parts=4)) == []


def test_copies_of_one_text(spark):
    """A text that holds a third of the rows: each copy links to its first row, over batches and names."""
    names = [None, "Mít Lười 12", "Ong 7"]
    data = [review(i, i // 100, names[i % 3] if i % 2 else None, LONG) for i in range(300)]
    data += [review(1000 + i, i // 200, None, " ".join(random.Random(i).choices([f"từ{j}" for j in range(500)], k=25))) for i in range(600)]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    got = dict((d, k) for k, d in rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4)))
    assert set(got) == set(range(1, 300)) and set(got.values()) == {0}


def test_text_that_spreads(spark):
    """Many names tell one text, each row with a word of its own: a name's second row links to its first, though all that they share is frequent."""
    base = [f"từ{j}" for j in range(40)]
    tell = lambda i: " ".join([*base[:20], f"khác{i}", *base[21:]])
    data = [review(i, 0, f"Ong {i}", tell(i)) for i in range(90)] + [review(100 + i, 0, f"Ong {i}", tell(100 + i)) for i in (5, 40, 89)]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    assert rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4)) == [(5, 105), (40, 140), (89, 189)]
    ids, who = np.arange(300), np.random.default_rng(1).integers(0, 9, 300)
    got = {(int(x), int(y)) for a, b in history._fitting(ids, who, 1000) for x, y in zip(a, b)}
    assert got == {(i, j) for i in range(300) for j in range(i) if who[i] == who[j] or not who[i] or not who[j]}


def test_chain_to_another_name(spark):
    """A row without a name between two names: the second name's rows repeat their own first row, in the batch and later."""
    edit = lambda w: LONG.replace("sẽ tạm được", w)
    data = [review(1, 0, "Ong 7", LONG), review(2, 0, None, LONG), review(3, 0, "Mít Lười 12", LONG), review(4, 0, "Mít Lười 12", LONG), review(5, 0, "Mít Lười 12", edit("sẽ ổn")), review(6, 1, "Mít Lười 12", edit("sẽ khá")), review(7, 1, "Ong 7", edit("sẽ khá"))]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    assert rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4)) == [(1, 2), (1, 7), (3, 4), (3, 5), (3, 6)]


OTHER_PROCESS = """
import sys
sys.path.insert(0, {root!r})
from banyan.llm import history
from banyan.session import build_session
spark = build_session(2, "2g")
df = spark.createDataFrame({rows!r}, "i long, b int, s string, n string, t string")
print("GOT", sorted(tuple(r) for r in history.repeated_rows(df, "i", "b", "s", "n", "t", folder={folder!r}).collect()))
"""


def test_store_goes_on_in_another_process(spark, tmp_path):
    """A later process opens the store, adds a batch without touching what is there, and finds repeats of its rows."""
    import subprocess
    import sys
    from pathlib import Path

    folder = str(tmp_path / "store")
    data = [review(1, 0, "Ong", LONG), review(2, 1, "Ong", "Review: " + LONG), review(3, None, None, LONG + " nhé"), review(4, 0, "Ong", LONG.replace("vải", "sen").replace("bún", "xôi") * 2)]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    assert rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4, folder=folder)) == [(1, 2), (1, 3)]  # a null batch comes last
    assert rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=4, folder=folder)) == []
    before = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.arrow")}
    code = OTHER_PROCESS.format(root=str(Path(history.__file__).resolve().parents[2]), rows=[review(9, 2, None, LONG.upper()), review(10, 2, None, "khác " * 30)], folder=folder)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "GOT [(1, 9)]" in out.stdout, out.stderr[-2000:]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and len(list(Path(folder).rglob("*.arrow"))) > len(before)


def test_segments_are_merged(spark, tmp_path):
    tells = [" ".join(random.Random(i).choices([f"từ{j}" for j in range(300)], k=20)) for i in range(12)]
    data = [review(100 * b + i, b, None, tells[i]) for b in range(10) for i in range(12)]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    got = {d: k for k, d in rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=3, folder=str(tmp_path / "s")))}
    assert got == {100 * b + i: i for b in range(1, 10) for i in range(12)}
    store = history.FingerprintStore(str(tmp_path / "s"))
    assert len(store.batches) == 10 and len(store.segments) == 3 and store.parts == 3 and len(list((tmp_path / "s" / "docs").iterdir())) == 3


def test_sorted_files_are_read_by_block(tmp_path, monkeypatch):
    monkeypatch.setattr(history, "ROWS", 5)
    k = np.sort(np.random.default_rng(2).integers(0, 40, 203))
    history._write(str(tmp_path / "x.arrow"), history._ipc(history.pa.table({"fp": k, "id": np.arange(203)}), "fp"))
    f = history.Sorted(str(tmp_path / "x.arrow"), "fp", most=3)
    asked = np.array([0, 3, 3, 17, 39, 55])
    got = sorted((int(a), int(v)) for q, vs in f.hits(asked, "id") for a, v in zip(q, vs))
    assert got == sorted((i, int(j)) for i, x in enumerate(asked) for j in np.flatnonzero(k == x)) and len(f.blocks) <= 3
    assert history.Sorted.open(str(tmp_path / "none.arrow"), "fp") is None


def test_history_against_all_pairs(spark):
    """Against a plain comparison of all texts of a store."""
    r = spark.read.parquet(f"{D}/review_fact.parquet").select("ingest_id", "store_id", "reviewer", "review_text").orderBy("ingest_id").collect()
    by_store, want = {}, {}
    for i, s, n, t in r:
        w, n = history.own_words(t), history.folded_name(n)
        if w:
            first = next((k for k, m, v in by_store.get(s, []) if history.names_fit(m, n) and history.same_account(v, w)), None)
            if first is None:
                by_store.setdefault(s, []).append((i, n, w))
            else:
                want[i] = first
    got = {d: k for k, d in rows(queries.p4_found(spark, D))}
    same = sum(want.get(d) == k for d, k in got.items())
    assert len(want) > 20 and same >= 0.97 * len(want) and same >= 0.97 * len(got)


def test_names():
    fit = lambda a, b: history.names_fit(history.folded_name(a), history.folded_name(b))
    assert fit("Mít Lười 12", "MIT LUOI 12") and fit(None, "x") and fit("không rõ", "x") and fit("M***12", "Mít lười 12")
    assert not fit("Mít Lười 12", "Ong lười 12") and not fit("M***13", "Mít lười 12")


def test_winnowing_keeps_shared_runs():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    run = [rng.choice(vocab) for _ in range(history.SHINGLE + history.WINDOW - 1)]
    texts = [[rng.choice(vocab) for _ in range(rng.randrange(30))] + run + [rng.choice(vocab) for _ in range(rng.randrange(30))] for _ in range(40)]
    fp, n = history.fingerprints(texts, ["k"] * 40)
    at = np.concatenate([[0], np.cumsum(n)])
    sets = [set(fp[a:b]) for a, b in zip(at, at[1:])]
    assert all(a & b for a in sets for b in sets)
    other, m = history.fingerprints(texts[:1], ["other key"])
    assert not set(other) & sets[0] and history.fingerprints([], [])[0].size == 0


def test_bits_rule_out_no_same_account():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randrange(6, 60))]
        texts += [t, t[: max(4, int(len(t) * rng.uniform(0.3, 1)))], [rng.choice(vocab) if rng.random() < 0.15 else w for w in t]]
    d = {"bits": history.word_bits(texts), "n": np.array([len(t) for t in texts]), "u": np.array([len(set(t)) for t in texts])}
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    may = history.may_be_same({k: v[i] for k, v in d.items()}, {k: v[j] for k, v in d.items()})
    same = np.array([history.same_account(texts[y], texts[x]) for x, y in zip(i, j)])
    assert not (same & ~may).any() and same.sum() > 300 and may.mean() < 0.1
    assert history.word_bits([]).size == 0


def test_own_words_of_many_texts():
    """Whole columns of texts give the words, fingerprints and sets that one text at a time gives, on odd signs as well."""
    r = random.Random(3)
    pieces = [*history.TAGS, "Review: ", "P/S:", "nhé mọi người", "Xem thêm", "...", "… xem thêm", "giao nhanh gọn gàng sạch", "a b", "mười", "1.000,5", *"aA1.,9 \n\t!…đĐăẮéİΣ\u0301\x00🍜;:/ｆﬁ"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(3000)] + [None, "", "!" * 50, "từ, " * 30]
    want = {i: w for i, x in enumerate(texts) if (w := history.own_words(x))}
    take, words = history.own_texts(texts)
    assert take.tolist() == list(want) and words.to_pylist() == [" ".join(w) for w in want.values()] and len(want) > 500
    codes, hashes, n = history._coded(words)
    got, expected = history._prints(hashes[codes], n, ["k"] * len(n)), history.fingerprints([*want.values()], ["k"] * len(n))
    assert all((a == b).all() for a, b in zip(got, expected))
    bits, n, u = history.word_sets(words, 100)
    assert (bits == history.word_bits([*want.values()])).all() and n.tolist() == [len(w) for w in want.values()] and u.tolist() == [len(set(w)) for w in want.values()]
    assert not len(history.own_texts([None, "ok"])[0]) and not len(history.word_sets(history.own_texts([])[1])[1])
    assert all(len(history.fold_ascii(chr(c))) < 2 for c in range(0x110000) if c != ord("…")) and not any(history.fold_ascii(chr(c)) for c in range(0x10000, 0x110000))


def test_words_in_another_order_are_ruled_out_before_they_are_matched(monkeypatch):
    """The longest blocks are sought only where a head of the longer text may have enough words; no pair that they accept is ruled out."""
    r = random.Random(5)
    for _ in range(20_000):
        a = [r.choice("abcdefgh") for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() < 0.8] + [r.choice("abcdefgh") for _ in range(r.randrange(6))]
        may = history._may_cover(*sorted((a, b), key=len), 0.8)
        with monkeypatch.context() as m:
            m.setattr(history, "_may_cover", lambda *_: True)
            assert may or a == b or not history.same_account(a, b)
    tried = []
    monkeypatch.setattr(history, "SequenceMatcher", lambda *x: tried.append(x) or SequenceMatcher(*x))
    a = [f"w{i}" for i in range(30)]
    assert not history.same_account(a, [f"v{i}" for i in range(30)] + a[10:] + a[:10] + ["x"] * 20) and not tried
    assert history.same_account(a, a[:-1] + ["x"]) and len(tried) == 1


def test_accepted_fingerprints_are_those_of_first_rows(spark, tmp_path):
    """A batch's files hold, sorted and with their filters, the fingerprints of its first rows and of copies; only those of other repeats are sent to be taken out."""
    tells = [" ".join(random.Random(i).choices([f"từ{j}" for j in range(300)], k=40)) for i in range(8)]
    data = [review(i, 0, None, t) for i, t in enumerate(tells)] + [review(10 + i, 0, None, t + " nhé") for i, t in enumerate(tells[:5])] + [review(20, 1, None, tells[0].upper()), review(21, 1, None, tells[7] + " ạ")]
    df = spark.createDataFrame(data, "i long, b int, s string, n string, t string")
    got = {d: k for k, d in rows(history.repeated_rows(df, "i", "b", "s", "n", "t", parts=3, folder=str(tmp_path / "s")))}
    assert got == {10 + i: i for i in range(5)} | {20: 0, 21: 7}
    held = {}
    for b in ("batch-0", "batch-1"):
        for f in sorted((tmp_path / "s" / "prints" / b).glob("*.arrow")):
            t = history.Sorted.open(str(f), "fp").table()
            fp, packed = t["fp"].to_numpy(), f.with_suffix(".bloom").read_bytes()
            assert (np.diff(fp) >= 0).all() and (fp % 3 == int(f.stem)).all()
            assert history.bloom_has(np.frombuffer(packed, np.uint8, offset=8), int.from_bytes(packed[:8], "little"), fp).all()
            held.setdefault(b, set()).update(t["id"].to_pylist())
    assert held == {"batch-0": set(range(8)), "batch-1": set()}


def test_bloom():
    a = np.arange(1000, dtype=np.int64) * 7919
    packed = history.bloom(a)
    assert history.bloom_has(packed, 10_000, a).all()
    assert history.bloom_has(packed, 10_000, a + 1).mean() < 0.05


def test_pairs_are_ruled_out_before_they_are_written(spark, tmp_path):
    """Of the pairs of a batch and its history those that the bits allow come out, once each, the later row first."""
    r = random.Random(8)
    words = [[f"w{r.randrange(400)}" for _ in range(40)] for _ in range(30)]
    words += [[*w[:36], "x", "y"] for w in words[:10]]
    s = "id long, store string, name string, text string"
    at = [(i, "a", "", " ".join(w)) for i, w in enumerate(words)]
    store = history.FingerprintStore(str(tmp_path), 4)
    for k, part in enumerate((at[:20], at[20:])):
        store.add(store.sketch(spark.createDataFrame(part, s), "id", "store", "name", "text"), f"batch-{k}")
    new, old = (x.ravel() for x in np.meshgrid(np.arange(20, 40), np.arange(40), indexing="ij"))
    got = [tuple(x) for p in history.allowed_pairs(history._docs(str(tmp_path)), np.tile(new, 2), np.tile(old, 2), "batch-1", ("batch-1", "batch-0"), 4) for x in p.tolist()]
    bits = history.word_bits(words)
    of = lambda i: {"bits": bits[[i]], "n": np.array([len(words[i])]), "u": np.array([len(set(words[i]))])}
    want = {(a, b) for a in range(20, 40) for b in range(a) if history.may_be_same(of(a), of(b))[0]}
    assert set(got) == want and len(got) == len(want) and {(30 + i, i) for i in range(10)} <= want and len(want) < 60


# --- 6: entities ---


def test_finished_steps_leave_no_shuffle_files(spark):
    """A stored or durable step drops its shuffles; blocks to split are found without a shuffle of all blocks."""
    from banyan.session import durable, stored

    def files():
        got = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(got.size()) if (n := got.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}

    before = files()
    df = spark.range(10_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    kept = [keep(d) for keep in (durable, lambda d: stored(d, "kept")) for d in (df.groupBy("k").count(), df.repartition(3))]
    assert not files() - before
    assert [d.count() for d in kept] == [50, 10_000, 50, 10_000]
    blocks = spark.createDataFrame([(1, i) for i in range(2500)] + [(2, i) for i in range(900)] + [(i, i) for i in range(10, 60)], "block bigint, l bigint")
    assert rows(entities.hot_blocks(blocks, "n", 1000)) == [(1, 3)]



def test_names_of_shops():
    assert entities.name_parts("Quán Vườn Khuya (Broken Rice)") == ("vuon khuya", "com tam")
    assert entities.name_parts("Rơm Mưa - Gà Rán Kiều Oanh Nguyệt") == ("rom mua kieu oanh nguyet", "ga ran")
    assert entities.name_parts("Phở Gió Nhỏ Hoa") != entities.name_parts("Phở Gió Nhỏ Mây")
    assert entities.name_parts("Muối Nâu phở & more") == ("muoi nau", "pho")
    assert entities.name_parts(None) == ("", "") and entities._edit1("nooodle", "noodle") and not entities._edit1("abc", "xyz")


def test_isotonic_and_fit():
    rng = np.random.default_rng(0)
    s = rng.normal(size=2000)
    y = (rng.uniform(size=2000) < 1 / (1 + np.exp(-2 * s))).astype(int)
    at, p = entities.isotonic(s, y)
    assert all(a <= b for a, b in zip(p, p[1:])) and all(a < b for a, b in zip(at, at[1:])) and all(0 < v < 1 for v in p)
    assert abs(np.interp(s, at, p).mean() - y.mean()) < 0.02 and entities.calibration_error(np.interp(s, at, p), y) < 0.02


def test_streets_in_names(spark):
    """A street at the end of a name is no part of its core, also where it is written wrongly; other words stay."""
    names = [("a", "Phở Gió Nhỏ - Sa Khê Bích"), ("b", "Phở Gió Nhỏ Sa Khêê Bích"), ("c", "Phở Gió Nhỏ Hoa Mai"), ("d", "Sa Khê Bích"), ("e", "Cà Phê Nắng & quán nhỏ"), ("f", None)]
    e = spark.createDataFrame([(k, n, None, None, None) for k, n in names], "id string, name string, street string, alleys string, house string")
    got = {r["id"]: r["core"] for r in entities.named(e, "name", "id", spark.createDataFrame([("sa khe bich",)], "street string")).collect()}
    assert got == {"a": "gio nho", "b": "gio nho", "c": "gio nho hoa mai", "d": "sa khe bich", "e": "nang", "f": ""}


def test_split_join(spark):
    """A block that holds most rows of both sides gives each pair once, in parts."""
    left = spark.createDataFrame([("hot" if i % 3 else f"b{i}", i) for i in range(90)], "block string, l long")
    right = spark.createDataFrame([("hot" if i % 2 else f"b{i}", i) for i in range(80)], "block string, r long")
    want = sorted((a["l"], b["r"]) for a in left.collect() for b in right.collect() if a["block"] == b["block"])
    assert rows(entities.split_join(left, right, 7).select("l", "r")) == want and len(want) > 2000


def test_confidence_is_calibrated(spark, monkeypatch):
    """On labels kept out of fit and calibration; with the prior model in the place of the fit the score separates less."""
    m = spark.read.parquet("/root/testdata/sf0.01/store_master.parquet")
    sides = entities.shop_sides(m)
    sample = entities.labelled_sample(entities.features(entities.candidates(*sides), *sides))
    model, x, y = entities.learn(sample)
    assert len(y) > 100 and 0 < y.mean() < 1 and entities.calibration_error(model.probability(x), y) <= 0.05
    loss = lambda w, b: float(np.mean(np.logaddexp(0, -(2 * y - 1) * (x @ w + b))))
    fitted = loss(model.weights, model.intercept)
    assert fitted < 0.7 * loss(*entities.fit(x[:1], np.array([1])))  # one label: the prior model
    z = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(model.confidence(model.score(F.col("x"))).alias("c")).toPandas()["c"].to_numpy()
    assert np.allclose(z, model.probability(x))
    found = {tuple(r) for r in entities.match(*sides).select("store_id", "place_id").collect()}
    monkeypatch.setattr(entities, "fit", lambda x, y, ridge=1.0: (np.zeros(len(entities.FEATURES)), 0.0))
    assert {tuple(r) for r in entities.match(*sides).select("store_id", "place_id").collect()} != found


def test_match_on_small_tables(spark):
    got = rows(queries.p6_found(spark, D))
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got}) > 5


def test_planted_shops(spark):
    """Held-out accuracy on shops whose places are known: other writings, chains, neighbours in one house, missing parts."""
    rng = random.Random(8)
    kinds = [("Phở", "Noodle Soup"), ("Trà Sữa", "Milk Tea"), ("Bún Chả", "Grilled Pork Noodle"), ("Lẩu", "Hotpot")]
    first, last = ["Mây", "Gió", "Sóc", "Cáo", "Nếp", "Tre", "Khói", "Lúa", "Vịt", "Ong", "Dừa", "Quất"], ["Tím", "Nhỏ", "Ngủ", "Vàng", "Lười", "Xinh", "Đêm", "Sớm", "Ấm", "Tròn"]
    streets = ["Hòe Kha Lộc", "Vũ Nga Sa", "Sa Khê Bích", "Châu Hòe Tâm"]
    cores = [f"{a} {b}" for a in first for b in last]
    rng.shuffle(cores)
    data, want = [], set()
    places = []
    for i in range(100):
        core, (vi, en) = ("Gió Nhỏ" if i % 10 == 0 else cores[i]), kinds[i % 4]
        house, street = 10 + i, streets[i % 4]
        lat, lng = 20.9 + i * 0.002, 105.5 + (i % 7) * 0.001
        places.append((f"gp{i:04d}xxxx", [f"{core} {en}", f"Quán {core} ({en})", f"{core} - {vi} {street}", history.fold(core).upper()][i % 4], f"SN {house} Đ. {street}, Q. Trầm Hạ 11100, Việt Nam" if i % 5 else None, lat + 0.0002 if i % 6 else None, lng if i % 6 else None))
        data.append([f"s{i}", i, f"{vi} {core} - {street}", f"Số {house} {street}, Phường Vũ Tùng, Quận Trầm Hạ", lat, lng, "Trầm Hạ"])
    for i, d in enumerate(data):
        j = i if i % 3 else (i * 7 + 3) % 100  # a third carries the block of another shop
        d += list(places[j])
        want.add((f"s{j}", places[j][0]))
    df = spark.createDataFrame([tuple(d) for d in data], "store_id string, row_id long, canonical_name string, address string, lat double, lng double, district string, google_place_id string, google_name string, google_address string, google_lat double, google_lng double")
    got = {(a, b) for a, b, _ in rows(entities.match_shops(df))}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def test_misspelt_names_are_candidates(spark):
    """Short cores with a letter or two wrong: some share no band, all are candidates where they share a place."""
    cols = "name string, core string, kind string, bands array<bigint>, address_bands array<bigint>, lat double, lng double, district string, street string, alleys string, house string"
    make = lambda key, got: spark.createDataFrame([(k, n, c, "", entities._bands(c), entities._address_bands(st, al, h), lat, lng, d, st, al, h) for k, n, c, lat, lng, d, st, al, h in got], f"{key} string, {cols}")
    pairs = [("la hong", "la houg"), ("gio nho", "gio nno"), ("may tim", "may tm"), ("nep", "nepp"), ("khoi vang", "hkoi vang"), ("soc luoi", "luoi soc"), ("x" * 40 + " tim", "x" * 20 + "y" + "x" * 19 + " tim")]
    assert not set(entities._bands("la hong")) & set(entities._bands("la houg"))
    lat = [20.9 + 0.1 * i for i in range(len(pairs))]
    stores = make("store_id", [(f"s{i}", a, a, lat[i], 105.5, None, None, None, None) for i, (a, _) in enumerate(pairs)] + [("d", "mua xinh", "mua xinh", None, None, "d", "t", "", "5"), ("far", "la hong", "la hong", 10.0, 105.5, None, None, None, None)])
    places = make("place_id", [(f"p{i}", b, b, lat[i] + 0.0005, 105.5, None, None, None, None) for i, (_, b) in enumerate(pairs)] + [("d", "mua xlnh", "mua xlnh", None, None, "d", "u", "", "6")])
    got = rows(entities.candidates(stores, places, spark.createDataFrame([], "store_id string, place_id string")).select("store_id", "place_id"))
    assert got == [("d", "d")] + [(f"s{i}", f"p{i}") for i in range(len(pairs))]


# --- 7: tokens ---


def test_tokens_round_trip(spark):
    texts = [None, "", " ", "Phở 🍜 đặć biệt <|endoftext|>", "é", "a" * 50_000, "日本\x00\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    path = tokens.tokenizer_path()
    e = tokens.encode(df, "text", path, ("doc_id", "text"), offsets=True, out="tok")
    r = e.select("doc_id", "text", "tok", "offsets", tokens.decode(F.col("tok"), path).alias("back")).collect()
    assert len(r) == len(texts)
    for x in r:
        assert x["back"] == (x["text"] or "") and len(x["tok"]) == len(x["offsets"])
    assert [x["tok"] for x in sorted(r, key=lambda x: x["doc_id"])][:2] == [[], []]
    assert 50256 not in {i for x in r for i in x["tok"]}
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(x["tok"] == enc.encode_ordinary(x["text"] or "") for x in r)


# --- 8: mixing ---


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", rng.randrange(1, 200)) for i in range(3000)] + [(9000, "big", 0), (9001, None, 5), (9002, "none", 7)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("big", 0.3, 1), ("small", 0.65, 3), ("gone", 0.05, 2), ("gone", 0.05, 2)], "source string, target_share double, max_repeat int")
    m = mixing.mix(df, t)
    r = m.collect()
    assert len({x["doc_id"] for x in r}) == len(r) and {x["source"] for x in r} == {"big", "small"}
    assert max(x["copies"] for x in r if x["source"] == "small") <= 3 and max(x["copies"] for x in r if x["source"] == "big") <= 1
    s = {x["source"]: x for x in mixing.shares(m, t).collect()}
    assert abs(s["big"]["share"] / s["small"]["share"] - 0.3 / 0.65) < 0.005 and s["gone"]["share"] == 0 and len(s) == 3
    assert mixing.mix(df.filter("false"), t).count() == 0
    assert rows(m) == rows(mixing.mix(df.repartition(7), t))


# --- 9: cuts ---


def test_limits_are_found():
    rng = np.random.default_rng(0)
    for at in (400, 250):
        n = np.concatenate([np.exp(rng.normal(5.3, 0.6, 15_000)), np.exp(rng.normal(4.1, 0.15, 5_000))]).astype(int)
        n = np.where(n > at, at, n)
        u, c = np.unique(n, return_counts=True)
        post = cuts.fit_source(u, c)
        assert set(post) == {at} and post[at] > 0.95
        whole, _, _, _ = cuts.fit_mixture(np.log(u[u > 0]), c[u > 0].astype(float), np.zeros((u > 0).sum()), 2)
        assert abs(whole.sum() - 1) < 1e-9
    u, c = np.unique(np.exp(rng.normal(5.3, 0.6, 20_000)).astype(int), return_counts=True)
    assert cuts.fit_source(u, c) == {} and cuts.fit_source(np.array([0]), np.array([3])) == {}


def test_shares_of_cuts():
    """A twentieth is cut, mostly within words: the cells that whole texts avoid tell it."""
    texts = {"closed": 800.0, "end": 150.0, "new": 40.0, "mid": 5.0, "open": 5.0}
    odds, ratio, share = cuts.learn_cells(texts, [{"new": 70.0, "mid": 2.0}, {"mid": 40.0, "end": 3.0}, {"open": 10.0}])
    assert 0.04 < share < 0.06 and odds["new"] > 2 and odds["end"] < 0.01 and odds["closed"] == 0 and ratio["mid"] > 10 > 1 > ratio["end"]
    assert cuts.learn_cells({}, [{}, {}, {}]) == ({}, {}, 0.0)


def test_cut_texts(spark):
    ends = ["Quán đông vào đêm mưa nhưng anh giữ xe vẫn niềm nở.", "Hết 95k cho 56 người, có cả lẩu nấm chay.", "Gửi xe mất 21k, đi bộ thêm 31 bước mới tới cửa."]
    data = [(i, "a", " ".join([ends[i % 3], ends[(i + 1) % 3]]) + ["", " 😋😋", "\nhttps://x.example/1", "..."][i % 4]) for i in range(300)]
    data += [(400 + i, "a", f"{ends[i % 3]} {ends[(i + 1) % 3][: 12 + i]}") for i in range(24)]
    data += [(902, "a", None), (903, "a", ""), (904, None, "  "), (905, "a", ends[0][:-1]), (906, "a", "!!!"), (907, "a", ends[2] + " Gửi xe m�"), (908, "a", "😋"), (909, "a", ends[0] + "\n- (4.0/5) "), (910, "a", (ends[0] + " ") * 3000 + "Gửi xe mất 2")]
    df = spark.createDataFrame(data, "k long, source string, text string").withColumn("base", F.lit("x"))
    out = cuts.detect_cuts(df, "k", "source", "text").collect()
    got, cut = {r["key"] for r in out if r["cut"]}, {*range(400, 424), 907, 910}
    assert len(out) == len(data) and got <= cut and len(got) >= 23 and {907, 910} <= got
    assert all(r["posterior"] == 0 for r in out if r["key"] in (902, 903, 904))
    assert cuts.detect_cuts(df.filter("false"), "k", "source", "text").count() == 0


def test_the_fit_decides(spark, monkeypatch):
    """Where endings say little, texts at the fitted limit are cut; without the fit they are not."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lambda: {r["key"]: r["at_limit"] for r in cuts.detect_cuts(df, "doc_id", "source", "text").filter("cut").collect()}
    a = found()
    monkeypatch.setattr(cuts, "length_limits", lambda e: spark.createDataFrame([], "source string, base int, prior double"))
    b = found()
    assert sum(a.values()) > 0.2 * len(a) and not any(b.values()) and set(a) != set(b)


# --- all ---


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, D)
    assert df.columns and df.count() >= 0


def test_p2_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("store_master", "store_source_map"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert rows(queries.p2_found(spark, D).select("tab", "row_key")) == sorted(c.execute(queries.SQL["p2_found"]).fetchall())
