"""Quality rules, decontamination, PII and URL lists beside brute force and DuckDB."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, pii, quality, registry, setjoin, urllists

SF = "/root/testdata/sf0.001"


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, seen, hit = [tuple(w[k : k + 3]) for k in range(len(w) - 2)], {}, set()
    for k, x in enumerate(windows):
        seen.setdefault(x, []).append(k)
    for at in seen.values():
        if len(at) > 1:
            hit |= {k + d for k in at for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(edge, edge_rows, empty):
    got = quality.digest(edge)
    assert python_free(got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *measured(t)) for i, t, *_ in edge_rows), key=key)
    rows = sorted((tuple(r[:6]) for r in got.collect()), key=key)
    assert rows == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.digest(empty).count() == 0


def test_quality_keeps_extra_columns(spark):
    df = spark.createDataFrame([(1, "x", "mine", 5)], "doc_id int, text string, kept string, other int")
    r = quality.judge(df).first()
    assert r.other == 5 and r.kept is False


def test_packed_places_fall_back(edge, edge_rows, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    got = {(r.doc_id, r.n_words): r.n_repeat_words for r in quality.digest(edge).collect()}
    assert all(got[i, measured(t)[0]] == measured(t)[4] for i, t, *_ in edge_rows)


def norm(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]


def contaminated(text, items):
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        g = norm(t)
        if not g:
            continue
        n = min(len(g), 10)
        grams = {tuple(g[k : k + n]) for k in range(len(g) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination(spark, edge, edge_rows, empty, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    some = edge_rows[12][1]
    items = [(10, some[40:400]), (9, "One, TWO: three!"), (2, None), (3, ""), (4, "one"), (9, "one two three"), (None, "never here at all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(edge, bench)
    assert python_free(got)
    items = [x for x in items if x[0] is not None]
    want = sorted(((i, *contaminated(t, items)) for i, t, *_ in edge_rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    clean = decontaminate.digest(edge, bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(edge_rows)
    assert decontaminate.digest(empty, bench).count() == 0
    cut = decontaminate.cut_spans(edge, bench)
    assert cut.columns == edge.columns and decontaminate.digest(cut, bench).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(edge, bench).count()
    assert kept == sum(not x[5] for x in want)


def test_decontamination_shuffles_no_text(spark, edge, monkeypatch):
    items = [(1, "one two three"), (2, "the of and the of and"), (3, "same line same line other")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda x: sorted(map(str, x.collect()))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    near = decontaminate.mark(edge, bench)
    assert "Exchange hashpartitioning" not in plan(near) and near.where("contaminated").count() == 3
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = decontaminate.mark(edge, bench)
        assert "Exchange hashpartitioning" in plan(far) and rows(near) == rows(far)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_decontamination_keeps_clashing_columns(spark, edge, edge_rows):
    names = ("_th", "_d", "_t", "_items", "_places", "_row", "n_words", "items", "h", "len")
    df = edge.withColumns({c: F.lit("mine") for c in names})
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == decontaminate.drop_contaminated(edge, bench).count()
    assert kept.where(" OR ".join(f"{c} <> 'mine'" for c in names)).count() == 0
    cut = decontaminate.cut_spans(df, bench)
    assert cut.columns == df.columns and cut.where("n_words <> 'mine'").count() == 0
    marked = decontaminate.mark(df, bench)
    assert marked.where("_th <> 'mine'").count() == 0 and marked.where("contaminated").count() > 0


PEOPLE = "Mr. John Smith wrote to Frau Müller and Señora Ana Ruiz; Господин Иван Петров too."
THINGS = "mail a.b@mail3.example.com, card 4111 1111 1111 1111 or 4111111111111112, 10.1.2.3 and 8.8.4.4, +1 (555) 123-4567, 123-45-6789"


def test_pii_surrogates(spark, edge, edge_rows, empty):
    rows = [(1, PEOPLE), (2, THINGS), (3, THINGS + " " + PEOPLE), (4, None), (5, ""), (6, "plain text, nothing here"), (1, PEOPLE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_email", F.lit("clash"))
    out = pii.anonymise(df)
    assert python_free(out)
    got = sorted(out.collect(), key=lambda r: (r.doc_id, r.text or ""))
    by = {r.doc_id: r for r in got}
    assert (by[4].text, by[5].text, by[6].text) == (None, "", rows[5][1])
    assert got[0] == got[1] and len(got) == len(rows)
    new = by[3].text
    assert by[2].text + " " + by[1].text == new  # the same entity, the same surrogate
    for gone in ("John", "Smith", "Müller", "Ruiz", "Петров", "a.b@mail3", "4111", "8.8.4.4", "123-45", "123-4567"):
        assert gone not in new
    assert re.search(r"Mr\. (%s) [A-Z][a-z]+ wrote" % "|".join(pii.MALE_NAMES), new)
    assert re.search(r"Frau [A-Z][a-z]+ and", new) and re.search(r"Señora (%s) " % "|".join(pii.FEMALE_NAMES), new)
    assert re.search(r"Господин (%s) [А-Я][а-я]+ too" % "|".join(pii.CYRILLIC_MALE), new)
    good, bad = re.search(r"card (4[0-9]{3}(?: [0-9]{4}){3}) or (4[0-9]{15}),", new).groups()

    def luhn(x):
        d = [int(c) for c in x.replace(" ", "")][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0

    assert luhn(good) and not luhn(bad)
    assert re.search(r"10\.\d+\.\d+\.\d+ and", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"[a-z]\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", new)
    assert pii.anonymise(empty).count() == 0 and pii.anonymise(edge).count() == len(edge_rows)
    r = by[3]
    assert (r.n_email, r.n_card, r.n_ip, r.n_phone, r.n_ssn, r.n_name) == (1, 2, 2, 1, 1, 4)


LEAKS = [
    ("Frau Dr. Merkel kam.", "Merkel", r"Frau Dr\. [A-Z][a-z]+ kam\."),
    ("Herr Prof. Dr. Karl Weiß kam.", "Weiß", r"Herr Prof\. Dr\. [A-Z][a-z]+ [A-Z][a-z]+ kam\."),
    ("Mr. McDonald left.", "Donald", r"Mr\. [A-Z][a-z]+ left\."),
    ("Dr. Jean-Luc Picard left.", "Luc|Picard", r"Dr\. [A-Z][a-z]+ [A-Z][a-z]+ left\."),
    ("Mr. O'Brien's car, and Mr. O’Neill.", "Brien|Neill", r"Mr\. [A-Z][a-z]+'s car, and Mr\. [A-Z][a-z]+\."),
    ("Mr. SMITH left.", "SMITH", r"Mr\. [A-Z]+ left\."),
    ("Mr. John Smith and JOHN SMITH.", "JOHN|SMITH|John|Smith", r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+ and [A-Z]+ [A-Z]+\."),
    ("write to josé@ex.com now", "josé|jos", r"write to [a-z]{4}@[a-z]{2}\.com now"),
    ("write to иван@почта.рф now", "иван|почта", r"write to [а-я]{4}@[а-я]{5}\.рф now"),
    ("Dr. Ελένη Παππά left.", "Ελένη|Παππά", r"Dr\. [Α-ΩΆ-Ώ][α-ωά-ώ]+ [Α-Ω][α-ω]+ left\."),
    ("Dr. Мария Кюри left.", "Мария|Кюри", rf"Dr\. (?:{'|'.join(pii.CYRILLIC_FEMALE)}) [А-Я][а-я]+ left\."),
    ("Mrs. Anna Smith and Mr. Anna Smith", "Anna|Smith", rf"Mrs\. (?:{'|'.join(pii.FEMALE_NAMES)}) ([A-Z][a-z]+) and Mr\. (?:{'|'.join(pii.MALE_NAMES)}) \1"),
]


def test_pii_leaks(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LEAKS)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.anonymise(df).collect()}
    for i, (text, gone, want) in enumerate(LEAKS):
        assert not re.search(gone, got[i]) and re.fullmatch(want, got[i]), (text, got[i])


def test_pii_numbers_are_known_by_digits(spark):
    phones = ["+1 (555) 123-4567", "+1 555 123 4567", "555-123-4567", "+44 20 7946 0958", "+44-20-7946-0958"]
    cards = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]
    df = spark.createDataFrame([(i, f"call {x} now") for i, x in enumerate(phones + cards)], "doc_id bigint, text string").withColumn("N_Phone", F.lit("mine"))
    out = pii.anonymise(df)
    assert out.columns == ["doc_id", "text", *(f"n_{k}" for k in pii.KINDS)]  # a column of that name in any case is replaced
    got = {r.doc_id: r.text[5:-4] for r in out.collect()}
    shape = lambda x: re.sub("[0-9]", "0", x)
    digits = lambda x: re.sub("[^0-9]", "", x)
    for i, x in enumerate(phones + cards):
        assert shape(got[i]) == shape(x) and digits(got[i]) != digits(x)
    assert digits(got[0])[1:] == digits(got[1])[1:] == digits(got[2]) and digits(got[3]) == digits(got[4]) and got[3].startswith("+44 ")
    assert digits(got[5]) == digits(got[6]) == digits(got[7])


def test_pii_few_exceptions_shuffle_no_text(spark, monkeypatch):
    text = " ; ".join(f"Mr. A{chr(97 + n % 26)}{chr(97 + n // 26)} Smi{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(120))
    df = spark.createDataFrame([(1, text), (2, text), (None, text)], "doc_id bigint, text string")
    monkeypatch.setattr(pii, "SYLLABLES", ("ba", "de"))  # 32 family names for 120 persons
    moved = pii.exceptions(df)
    near = pii.replace(df, moved=moved)
    assert moved.count() > 50 and "hashpartitioning(_d" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pii, "BROADCAST_MOVED", 0)
    far = pii.replace(df, moved=moved)
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(near) == rows(far)
    names = [x.split(" ")[-1] for x in near.where("doc_id = 1").first().text.split(" ; ")]
    assert len(set(names)) == 120


def test_pii_collisions_move_on(spark, monkeypatch):
    """With a tiny space of surrogates, distinct entities still get distinct ones."""
    monkeypatch.setattr(pii, "_alike", lambda m, d: F.concat(F.lit("+1 555 55 5"), F.conv(F.substring(d, 1, 2), 16, 10)))
    text = " ; ".join(f"+1 (555) 123-{n:04d}" for n in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " again")], "doc_id bigint, text string")
    moved = pii.exceptions(df)
    assert moved is not None and moved.count() > 0
    out = {r.doc_id: r.text for r in pii.replace(df, moved=moved).collect()}
    pieces = out[1].split(" ; ")
    assert len(set(pieces)) == 60 and out[2] == out[1] + " again"


def test_pii_mentions_of_one_person(spark):
    """Title and family name, bare full name, with or without the dot: one identity in the whole text."""
    one = "Mr. John Smith came. Mr. Smith left. John Smith wrote. Mr John Smith. Dr. John Smith too; Johnny John Smithson stays."
    two = "Ms Jane Roe and Mr Tim Roe met Dr. Roe; Mr. Smith came."
    df = spark.createDataFrame([(1, one), (2, two), (None, one), (3, "John Smith is nobody's title here. Mr. John Smith"), (4, "John Smith alone")], "doc_id bigint, text string")
    out = pii.anonymise(df)
    assert python_free(out)
    by = {r.doc_id: r for r in out.collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Mr\. (\w+) left\. (\w+ \w+) wrote\. Mr (\w+ \w+)\. Dr\. (\w+ \w+) too; Johnny John Smithson stays\.", by[1].text)
    given, family, alone, *full = m.groups()
    assert given in pii.MALE_NAMES and alone == family and set(full) == {f"{given} {family}"} and family != "Smith"
    assert by[1].n_name == 5 and by[None].text == by[1].text
    m = re.fullmatch(r"Ms (\w+) (\w+) and Mr (\w+) (\w+) met Dr\. (\w+); Mr\. (\w+) came\.", by[2].text)
    assert m[1] in pii.FEMALE_NAMES and m[3] in pii.MALE_NAMES and len({m[2], m[4], m[5], m[6], family}) == 5
    assert by[3].text == f"{given} {family} is nobody's title here. Mr. {given} {family}" and by[4].text == "John Smith alone"


def test_pii_used_up_shapes_grow(spark):
    """Every shape of these addresses is taken by another of them; clashing columns pass through."""
    mails = [f"{i}@{j}.com" for i in range(10) for j in range(10)]
    hosts = [f"192.168.{i}.{j}" for i in range(1, 255, 25) for j in range(1, 255, 25)]
    df = spark.createDataFrame([(1, " ".join(mails)), (2, " ".join(hosts)), (3, mails[3])], "doc_id bigint, text string").withColumns(
        {c: F.lit("mine") for c in ("_e", "_d", "_t", "_tries", "n_ip")}
    )
    moved = pii.exceptions(df)
    got = {r.doc_id: r for r in pii.replace(df, moved=moved).collect()}
    new = got[1].text.split(" ")
    assert len(new) == len(set(new)) == 100 and not set(new) & set(mails) and all(re.fullmatch(pii.EMAIL, x) for x in new)
    assert len(set(got[2].text.split(" "))) == len(hosts) and not set(got[2].text.split(" ")) & set(hosts)
    assert got[3].text == new[3] and got[1]._e == "mine" and got[1].n_ip == 0 and got[2].n_ip == len(hosts)


def test_url_lists(spark):
    e = spark.createDataFrame(
        [("l", "bad.org", "add", 10), ("l", "bad.org", "remove", 20), ("l", "bad.org", "add", 20), ("l", "a.bad.org", "add", 15), ("m", "bad.org", "add", 30),
         ("m", "bad.org", "add", 40), (None, "x", "add", 1), ("l", "y.org", "hm", 1), ("l", "Z.org", "add", 5)],
        "list string, pattern string, action string, at int",
    )
    c = spark.createDataFrame(
        [(1, "http://a.bad.org/x", 9), (2, "http://a.bad.org:80/x", 10), (3, "https://u@A.BAD.org", 16), (4, "http://bad.org", 20), (5, "http://notbad.org", 16),
         (6, None, 16), (7, "nonsense", 16), (8, "http://bad.org", None), (9, "http://bad.org", 35), (9, "http://bad.org", 35), (10, "http://z.org./", 5)],
        "id int, url string, fetched_at int",
    )
    for bound in (100, 0):
        got = sorted((r.id, r.n_matches, r.listed, r.list, r.pattern) for r in urllists.judge(c, e, broadcast_rows=bound).collect())
        off = lambda i: (i, 0, False, None, None)
        assert got == [off(1), (2, 1, True, "l", "bad.org"), (3, 2, True, "l", "a.bad.org"), off(4), off(5), off(6), off(7), off(8), (9, 1, True, "m", "bad.org"), (9, 1, True, "m", "bad.org"), (10, 1, True, "l", "z.org")]
    assert urllists.judge(c, e.limit(0)).where("listed").count() == 0 and urllists.judge(c.limit(0), e).count() == 0


def test_url_lists_keep_clashing_columns(spark):
    e = spark.createDataFrame([("l", "bad.org", "add", 10)], "list string, pattern string, action string, at int")
    c = spark.createDataFrame([(1, "http://a.bad.org/x", 12)], "page_id int, url string, fetched_at int").withColumns({x: F.lit("mine") for x in ("_known", "_now", "_host", "listed")})
    r = urllists.judge(c, e).first()
    assert (r._known, r._now, r._host, r.listed, r.pattern) == ("mine", "mine", "mine", True, "bad.org")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    d = duckdb.connect()
    d.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "benchmark", "pages", "embeddings"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = d.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted(map(repr, r.fetchall()))
    got = sorted(repr(tuple(x)) for x in registry.QUERIES[name](spark, SF).select(*names).collect())
    assert got == want


def test_setjoin_is_registered():
    assert setjoin.WIDTH == 5 and setjoin.PERCENT == 75
