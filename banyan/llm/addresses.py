"""Postal addresses that denote the same house.

`parse_address` splits an address into components (floor and stall, landmark, house number, alleys from the street inwards, street, ward,
district, city), whatever their order and abbreviations, by a dictionary of the locale's words; everything is folded (lower case, no
accents). `locate` fills missing components by rules and makes one hierarchical key a record:

1. a district named in the text holds, if it is the district of some record's street of that name;
2. else the areas named in the text decide: (street, area) must lie in one district of the gazetteer, which is built
   from all records that name both;
3. else the record's own district (from the columns of its table) if the gazetteer has the street there;
4. else the street decides where it lies in one district only;
5. else the record has no key and matches nothing.

A rare spelling of a street within a district becomes a more frequent one that is one edit away. Records with equal keys (district,
street, alleys, house number with its letter) denote the same house. Floor, stall, landmark, ward and city only help to find the district.

Defined results: null, blank and stand-in addresses, and addresses without a street or house number, match nothing; addresses of any length are
parsed whole; repeated records pair like any others; the pairs of a house with many records are made by a join on key
and salt, so no task holds more than a share of them; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banyan.llm.history import fold
from banyan.session import durable, real_text

#: The locale's address words, folded.
FLOOR = r"(?:tang|lau|t)\s*\d+[a-z]?(?!\w)|(?:ki-?\s?ot|kiosk|quay|lo|gian|sap|shop)\s*(?:so\s*)?(?:[a-z]?\d+[a-z]?(?!\w)|(?<=\s)[a-z]\b)"
LANDMARK = r"(?:doi dien|canh|ben canh|gan|ngay|sau lung|phia sau|truoc cua|dau|cuoi|trong)\s"
HOUSE = r"so nha|sn|so|nha so|no\.?|nha"
ALLEY = {"ngo": 0, "ng": 0, "ng.": 0, "kiet": 0, "ngach": 1, "ngh.": 1, "hem": 2}
STREET = r"duong|d\.|pho|p\."
WARD, DISTRICT, CITY = r"phuong\s+|p\.\s*|p\s+|xa\s+|thi tran\s+|tt\.\s*", r"quan\s+|q\.\s*|q\s+|huyen\s+|h\.\s*|thi xa\s+|tx\.\s*", r"thanh pho\s+|tp\.?\s*|t\.p\.?\s*|tinh\s+"
COUNTRY = ("viet nam", "vietnam", "vn")

_floor = re.compile(rf"^(?:{FLOOR})[\s,]*")
_number = re.compile(rf"(?:\b(?P<alley>ngach|ngo|ng\.?|hem|kiet|ngh\.)\s*(?:so\s*)?)?(?:\b(?:{HOUSE})\s*)?(?<![\w/])(?P<path>\d+[a-z]?(?:\s?/\s?\d+[a-z]?)*)(?![\w])")
_road = re.compile(r"(?i)\bđường\b")
_street = re.compile(rf"^(?:(?:d\.|p\.)\s*|pho\s+)(?=\S)|^(?:{STREET})$|^duong\s+(?=\S+\s+\S+\s+\S)")  # "duong" also begins names
_ward, _district, _city = (re.compile(rf"^(?:{x})(?=\D)") for x in (WARD, DISTRICT, CITY))
_post = re.compile(r"\s+\d{5,6}$")


def _squeeze(t: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def parse_address(text: str | None) -> dict | None:
    """The components of an address; None where it has no street or no house number."""
    if not text:
        return None
    t = re.sub(r"\([^)]*\)?", " ", fold(_road.sub("d. ", unicodedata.normalize("NFC", text))))
    parts = [re.sub(r"\s+", " ", p).strip(" .") for p in re.split(r"[,;\n]|\s[-–|]\s", t)]
    numbers: list[tuple[str | None, list[str]]] = []
    streets: list[tuple[int, str]] = []
    found: dict[str, str] = {}
    areas: list[str] = []
    for p in parts:
        p = _post.sub("", p).strip()
        if not p or p in COUNTRY:
            continue
        for c in COUNTRY:
            if p.endswith(" " + c):
                p = p[: -len(c)].strip()
        p = _post.sub("", p)
        while m := _floor.match(p):
            p = p[m.end() :].strip(" .-")
        if not p or re.match(LANDMARK, p):
            continue
        if re.search(r"\d", p) and not _city.match(p) and not _district.match(p):
            end = 0
            hit = False
            for m in _number.finditer(p):
                numbers.append((m["alley"], re.sub(r"\s", "", m["path"]).split("/")))
                end, hit = m.end(), True
            name = p[end:].strip(" .") if hit else p
            name = _squeeze(_street.sub("", name).strip())
            if len(name) > 1 and not re.search(r"\d", name):
                streets.append((0, name))
            elif hit and end:
                before = _squeeze(_street.sub("", p[: _number.search(p).start()].strip()))
                if len(before) > 3 and not re.search(r"\d", before):
                    streets.append((2, before))
            continue
        if m := re.match(r"^(?:d\.|pho\s)\s*|^duong\s+(?=\S+\s+\S+\s+\S)", p):
            if len(p) > m.end():
                streets.append((1, _squeeze(p[m.end() :])))
            continue
        for kind, pattern in (("city", _city), ("district", _district), ("ward", _ward)):
            if m := pattern.match(p):
                found.setdefault(kind, _squeeze(p[m.end() :]))
                areas.append(_squeeze(p[m.end() :]))
                if kind == "ward" and len(areas[-1].split()) >= 3:
                    streets.append((3, areas[-1]))  # "P." also stands for "Phố"
                break
        else:
            areas.append(_squeeze(p))
            if len(p.split()) >= 3:
                streets.append((4, _squeeze(p)))
    if not numbers or not streets:
        return None
    street = min(streets, key=lambda x: x[0])[1]
    levels: dict[int, list[str]] = {}
    house: list[str] = []
    for alley, path in numbers:
        if alley:
            levels.setdefault(ALLEY.get(alley, 0), path)
        elif not house:
            house = path
    if not house:
        return None
    inner = levels.get(1, [])
    alleys = inner if len(inner) > 1 else levels.get(0, []) + inner
    alleys = alleys + levels.get(2, [])
    alleys = alleys + house[:-1]
    return {
        "house": house[-1], "alleys": "/".join(alleys), "street": street, "ward": found.get("ward"), "district": found.get("district"), "city": found.get("city"),
        "areas": list(dict.fromkeys(a for a in areas if a and a != street)),
    }


PARSED = "house string, alleys string, street string, district string, areas array<string>"


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the components of its addresses, without the rows that have none; own is folded."""
    types = dict(df.dtypes)
    keep = [c for c in df.columns if c not in (text, "own")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_address(x) for x in b.column(text).to_pylist()]
            at = [i for i, g in enumerate(got) if g]
            s = b.take(pa.array(at, pa.int64()))
            cols = [s.column(c) for c in keep]
            cols.append(pa.array([_squeeze(fold(x)) if x else None for x in s.column("own").to_pylist()], pa.string()))
            for f in ("house", "alleys", "street", "district"):
                cols.append(pa.array([got[i][f] for i in at], pa.string()))
            cols.append(pa.array([got[i]["areas"] for i in at], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "own", "house", "alleys", "street", "district", "areas"])

    return df.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "own string", PARSED]))


def _deletes(c):
    """The string and all strings with one character less."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def spellings(named: DataFrame) -> DataFrame:
    """(district, street, better): a street spelling and the more frequent one, an edit away, in the same district.

    `named` has (district, street) rows.
    """
    n = named.groupBy("district", "street").agg(F.count("*").alias("n"))
    keyed = n.withColumn("k", F.explode(_deletes(F.col("street"))))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, (F.col("a.district") == F.col("b.district")) & (F.col("a.k") == F.col("b.k")) & ((F.col("b.n") >= 3 * F.col("a.n")) | ((F.col("a.n") == 1) & (F.col("b.n") >= 2))), "inner")
    near = near.filter(F.levenshtein("a.street", "b.street", 2).between(1, 2))
    return near.groupBy("a.district", "a.street").agg(F.max_by("b.street", F.struct("b.n", "b.street")).alias("better"))


def locate(records: DataFrame) -> DataFrame:
    """(rec, store_id, district, street, alleys, house) of each record that has a key.

    `records` has (rec, store_id, text, own): own is the district that the record's table names, if any.
    """
    p = durable(parse(records))
    # the gazetteer: streets and the districts that texts or tables name with them
    sure = p.select("street", "areas", F.coalesce("district", "own").alias("district"), F.col("district").isNotNull().alias("said"), "own").filter("district is not null")
    counted = sure.groupBy("street", "district").agg(F.count("*").alias("n"), F.count_if("said").alias("said"))
    known = counted.filter("n >= 2").select("street", "district").withColumn("ok", F.lit(True))
    by_area = sure.filter("said or own is not null").withColumn("area", F.explode("areas")).groupBy("street", "area", "district").agg(F.count("*").alias("n"))
    top = by_area.groupBy("street", "area").agg(F.max_by("district", F.struct("n", "district")).alias("by_area"), F.max("n").alias("most"), F.sum("n").alias("all"))
    top = top.filter("most >= 0.8 * all").drop("most", "all")
    alone = counted.groupBy("street").agg(F.max_by("district", F.struct("n", "district")).alias("by_street"), F.max("n").alias("most"), F.sum("n").alias("all")).filter("most >= 0.95 * all").drop("most", "all")

    r = p.join(known.withColumnRenamed("ok", "said_ok"), ["street", "district"], "left")
    r = r.join(known.select("street", F.col("district").alias("own"), F.col("ok").alias("own_ok")), ["street", "own"], "left")
    areas = p.select("rec", "street", F.explode("areas").alias("area")).join(top, ["street", "area"]).groupBy("rec").agg(F.min("by_area").alias("lo"), F.max("by_area").alias("hi"))
    r = r.join(areas.filter("lo = hi").select("rec", F.col("lo").alias("by_area")), "rec", "left").join(alone, "street", "left")
    # an area that the record's own table calls its district needs no gazetteer
    own_said = F.array_contains("areas", F.col("own"))
    district = F.coalesce("district", F.when(own_said, F.col("own")), "by_area", F.when(F.col("own_ok"), F.col("own")), "by_street", "own")
    r = r.select("rec", "store_id", district.alias("district"), "street", "alleys", "house").filter("district is not null")
    r = durable(r)
    better = spellings(r)
    return r.join(better, ["district", "street"], "left").select("rec", "store_id", "district", F.coalesce("better", "street").alias("street"), "alleys", "house")


def same_house(records: DataFrame, most: int = 1000) -> DataFrame:
    """(rec_a, rec_b): pairs of records of different stores that denote the same house, the smaller key first."""
    key = ["district", "street", "alleys", "house"]
    k = durable(locate(records).select(F.xxhash64(*key).alias("k"), "rec", "store_id", *key))
    many = k.groupBy("k").agg(F.min("store_id").alias("lo"), F.max("store_id").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("k", "n")
    k = k.join(many, "k")
    # each left record meets all parts of the right side, of about `most` records each
    parts = F.ceil(F.col("n") / most).cast("int")
    left = k.select(*key, "k", F.col("rec").alias("rec_a"), F.col("store_id").alias("store_a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    right = k.select(*key, "k", F.col("rec").alias("rec_b"), F.col("store_id").alias("store_b"), F.pmod(F.xxhash64("rec"), parts).cast("int").alias("salt"))
    pairs = left.join(right, ["k", "salt", *key]).filter((F.col("rec_a") < F.col("rec_b")) & (F.col("store_a") != F.col("store_b")))
    return pairs.select("rec_a", "rec_b")


def address_records(master: DataFrame, source_map: DataFrame, location: DataFrame) -> DataFrame:
    """(rec, store_id, text, own) of the four address fields."""
    own = master.groupBy("store_id").agg(F.max(real_text(F.col("district"))).alias("own"))
    m = master.select("store_id", "row_id", "address", "google_address").join(own, "store_id", "left")
    a = m.select(F.concat(F.lit("a"), "row_id").alias("rec"), "store_id", real_text(F.col("address")).alias("text"), "own")
    g = m.select(F.concat(F.lit("g"), "row_id").alias("rec"), "store_id", real_text(F.col("google_address")).alias("text"), "own")
    s = source_map.select(F.concat(F.lit("s"), "map_id").alias("rec"), "store_id", real_text(F.col("address_raw")).alias("text")).join(own, "store_id", "left")
    loc = location.select("store_id", "canonical_address", "district").dropDuplicates(["store_id", "canonical_address"])
    l = loc.select(F.concat(F.lit("l"), "store_id").alias("rec"), "store_id", real_text(F.col("canonical_address")).alias("text"), real_text(F.col("district")).alias("own"))
    return a.unionByName(g).unionByName(s).unionByName(l).filter("text is not null and store_id is not null")
