import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, similarity, texts
from tests.core import plain_similarity as plain


def one(spark, column, **values):
    literals = {k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in literals.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, key",
    [
        ("Green Planet Inc", "GREEN PLANET"),
        ("Atrium Innovation Limited", "ATRIUM INNOVATION"),
        ("Estar Technologies Ltd.", "ESTAR TECHNOLOGIES"),
        ("MINIMED, INC.", "MINIMED"),
        ("The A&B Holding Co", "A AND B"),
        ("Straße GmbH", "STRASSE"),
        ("  ", ""),
        (None, None),
    ],
)
def test_normalize_name(spark, raw, key):
    assert one(spark, names.normalize_name(F.col("v")), v=raw) == key


def test_missing_names_stringify_on_request(spark):
    assert one(spark, names.normalize_name(F.col("v"), "None"), v=None) == "NONE"


def test_families_and_ids(spark):
    assert [one(spark, names.entity_family(F.col("v")), v=v) for v in ("X GmbH Inc", "X Inc", "X", None)] == ["foreign", "domestic", "none", "none"]
    assert [one(spark, names.normalize_fei(F.col("v")), v=v) for v in ("1000139935.0", "0012-34", None)] == ["1000139935", "1234", ""]
    assert [one(spark, names.padded_key(F.col("v")), v=v) for v in ("1234", "1234.0", "x", None)] == ["001234", "001234", None, None]
    assert one(spark, names.slug(F.col("v"), 8), v="--Acme & Sons!") == "acme-son"
    assert one(spark, names.shares_word(F.lit("Acme Medical"), F.lit("ACME Devices")), v="") is True
    assert one(spark, names.shares_word(F.lit("Zeta Medical"), F.lit("ACME Medical")), v="") is False
    assert one(spark, names.collapse(F.col("v")), v=" a  \t b\n") == "a b"
    assert one(spark, names.list_key(F.col("v")), v="Foo D.B.A. Bar, L.L.C.") == "FOO BAR"
    assert one(spark, names.issuer_key(F.col("v")), v="FOO CORP /DE/") == "FOO"
    assert one(spark, names.joined(F.array(F.lit("a"), F.lit(None), F.lit("b"))), v="") == "a; b"
    assert one(spark, names.joined(F.array(F.lit(None).cast("string"))), v="") is None
    assert one(spark, names.document_url("https://x", F.lit("0000123"), F.lit("1-2-3"), F.lit("d.htm")), v="") == "https://x/123/123/d.htm"


@pytest.mark.parametrize(
    "day, end", [("2006-10-01", "2006-09-30"), ("2015-12-26", "2015-12-31"), ("2020-03-15", "2020-02-29"), ("2020-03-16", "2020-03-31")]
)
def test_nearest_month_end(spark, day, end):
    assert str(one(spark, dates.nearest_month_end(F.col("v").cast("date")), v=day)) == end


def test_dates(spark):
    d = F.col("v").cast("date")
    assert [one(spark, dates.federal_fiscal_year(d), v=v) for v in ("2015-10-01", "2015-09-30")] == [2016, 2015]
    assert [one(spark, dates.parse_date(F.col("v")), v=v) for v in ("1/5/2020", "2020-01-05", "x", None)] == [date(2020, 1, 5)] * 2 + [None] * 2
    assert abs(one(spark, dates.fiscal_position(d), v="2020-04-01") - (2020 + 183 / 365.25)) < 1e-9
    got = [str(one(spark, dates.cycle_month_end(d, F.lit(c)), v="2020-05-20")) for c in (0, 1, 2)]
    assert got == ["2020-03-31", "2020-04-30", "2020-02-29"]
    found = one(spark, dates.text_dates(F.col("v")), v="Dated March 3, 2020 and  APRIL 1st 2021; Foo 3, 2020; 2/30/2020 5/6/07 5/6/2008")
    assert found == [date(2020, 3, 3), date(2021, 4, 1), date(2007, 5, 6), date(2008, 5, 6)]
    assert one(spark, dates.nearest_gap(dates.text_dates(F.col("v")), F.lit("2020-03-10").cast("date")), v="March 3, 2020") == 7


def test_similarity_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, similarity.token_sort_ratio(a, b), a="GREEN PLANET", b="PLANET GREEN") == 100.0
    assert round(one(spark, similarity.token_sort_ratio(a, b), a="ATRIUM INNOVATION", b="ATRIUM INNOVATIONS"), 1) == 97.1
    assert round(one(spark, similarity.token_sort_ratio(a, b), a="ESTAR TECHNOLOGIES", b="STAR TECHNOLOGIES"), 1) == 97.1
    assert one(spark, similarity.token_set_ratio(a, b), a="ACME", b="ACME DEVICES") == 100.0
    pairs = [("ACME DEVICES", "DEVICES ACME", 100.0), ("ACME", "ACME", 100.0), ("ACME", "ACME DEVICES", 99.0)]
    assert all(one(spark, similarity.name_score(a, b), a=x, b=y) == score for x, y, score in pairs)
    assert one(spark, similarity.name_score(a, b), a="ACME", b="ZETA DEVICES") < 50


SIMILARITIES = {"common_length_of": plain.common_length, "indel_ratio": plain.ratio, "token_sort_ratio": plain.token_sort, "token_set_ratio": plain.token_set, "name_score": plain.score_names}


def similar_pairs(rng, n):
    """Pairs of names: unlike, edited, with words in another order, long, of one letter, of odd white space and letters."""
    vocabulary = ["ACME", "ZETA", "MEDIC", "DEVICE", "EAST", "OF", "A", "AÉRO", "𝔘NI", "X" * 40, "LABORATORIES", "INTERNATIONAL"]
    for _ in range(n):
        a = rng.choice([" ", "  ", "\u00a0", "\t"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 4, 9])))
        b = list(a) if rng.random() < 0.6 else list("".join(rng.choices("ABCE ", k=rng.randint(0, 70))))
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("ABQ ")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        b = "".join(b).split(" ") if rng.random() < 0.5 else ["".join(b)]
        rng.shuffle(b)
        yield a, " ".join(b)


def test_similarities_equal_their_definition(spark):
    import random

    lengths = [("A" * n, "A" * m) for n in (61, 62, 63, 124, 125, 400) for m in (0, 1, 62, 63, 130)]
    blank = [("", ""), ("", "A"), (" ", "A"), ("A", "A  A"), ("A A", "A"), ("A\x1cB", "B A")]
    pairs = blank + lengths + list(similar_pairs(random.Random(4), int(os.environ.get("TEST_PAIRS", "1500"))))
    df = spark.createDataFrame([(*p,) for p in [*pairs, (None, "A"), ("A", None)]], "a string, b string").repartition(8)
    got = df.select("a", "b", *[getattr(similarity, f)(F.col("a"), F.col("b")).alias(f) for f in SIMILARITIES])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for row in got.collect():
        want = None if row.a is None or row.b is None else [f(row.a, row.b) for f in SIMILARITIES.values()]
        found = [row[f] for f in SIMILARITIES]
        assert found == (want or [None] * 5), (row.a, row.b, found, want)


def test_markup(spark):
    page = "<html><style>p{}</style><script>x<y</script><p>A&nbsp;&amp; B</p>\n<b>c</b></html>"
    assert one(spark, texts.html_to_text(F.col("v")), v=page) == "A & B c"
    assert one(spark, texts.html_to_text(F.col("v"), every_entity=True), v="<p>&eacute;&nbsp;x</p>") == "é x"
    body = "<body><nav>skip</nav><article><h1> Title </h1><script>no</script><p>One  two</p>Page Last Updated: x</article></body>"
    assert texts.content_text(body) == "Title\nOne two"
    assert texts.content_text("<body><div class='a middle-column'>in</div>out</body>") == "in"
    assert texts.content_text("<div role='main'>m</div>") == "m" and texts.content_text("plain") == "" and texts.content_text(None) is None


def test_leads(spark):
    text = "Intro Item 2.01 first part. Item 9.01 second part."
    assert one(spark, texts.lead(F.col("v"), 12), v=text) == "Item 2.01 fi Item 9.01 se"
    assert one(spark, texts.lead_source(F.col("v")), v=text) == "item_anchored"
    assert one(spark, texts.lead(F.col("v"), 12, 5), v="no items here") == "no it"


def flags(spark, text):
    f = texts.event_flags(F.col("v"), texts.lead(F.col("v")))
    return spark.range(1).select(F.lit(text).alias("v")).select(*[c.alias(k) for k, c in f.items()]).first().asDict()


def test_event_flags(spark):
    f = flags(spark, "Item 8.01 The FDA issued a Warning  Letter; an untitled letter followed.")
    assert f["has_fda_context"] and f["flag_warning_letter"] == 1 and f["flag_untitled_letter"] == 1
    assert (f["n_flags"], f["n_flags_incl_untitled"]) == (1, 2)
    f = flags(spark, "A warning letter about rent.")
    assert not f["has_fda_context"] and f["flag_warning_letter"] == 0 and f["body_mentions_warning_letter"] == 1
    f = flags(spark, "premarket device: voluntary recall and class II recall; MDR reports")
    assert f["flag_recall"] == 1 and f["flag_adverse_event"] == 1
    assert flags(spark, "two 510(k)s were filed")["has_fda_context"] and not flags(spark, "a 510(k) was filed")["has_fda_context"]


@pytest.mark.parametrize("hits, label", [((2, 1, 0), "mixed"), ((3, 1, 0), "device"), ((1, 0, 0), "device"), ((1, 1, 0), "mixed"), ((0, 0, 0), "unspecified"), ((0, 0, 4), "biologic")])
def test_domain_label(spark, hits, label):
    columns = {n: F.lit(h) for n, h in zip(("device", "drug", "biologic"), hits)}
    assert one(spark, texts.domain_label(columns), v="") == label


def test_sections(spark):
    toc = "Item 1A. Risk Item 1B. Item 7. MDA Item 8. "
    text = toc + "Item 1A. " + "risk " * 100 + "Item 1B. x Item 7. " + "short Item 7A. y"
    df = spark.range(1).select(F.lit(text).alias("t"), F.lit("10-K").alias("f"))
    got = df.select(texts.section(F.col("t"), F.col("f"), "risk_factors").alias("r"), texts.section(F.col("t"), F.col("f"), "mda").alias("m")).first()
    assert got.r.startswith("Item 1A. risk") and got.r.endswith("risk ") and got.m == ""


def longest_between(text, start, ends):
    """The longest stretch from a start to the nearest end after it; the first of equals."""
    stops = sorted(m.start() for end in ends for m in re.finditer(end, text, re.I))
    best = ""
    for m in re.finditer(start, text, re.I):
        after = [s for s in stops if s > m.start()]
        if after and after[0] - m.start() > len(best):
            best = text[m.start() : after[0]]
    return best


def test_widest_span_against_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    made = ["".join(rng.choices(["a", "b", "c", "A1", "é", "🙂", "\n", "xy"], k=rng.randrange(80))) for _ in range(200)] + ["", "aa", "a1b a2b", "ab" * 3000]
    df = spark.createDataFrame([(t,) for t in [*made, None]], "t string").select("t", texts.widest_span(F.col("t"), r"a1|a", ("b", r"c\s")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == {None: None} | {t: longest_between(t, r"a1|a", ("b", r"c\s")) for t in made}
    assert "Python" not in df._jdf.queryExecution().toString()


def test_running_sums(spark):
    import itertools

    for n in (0, 1, 2, 3, 10, 1000):
        got = spark.range(1).select(texts.running(F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, n), lambda x: x.cast("long"))).alias("x")).first().x
        assert got == list(itertools.accumulate(range(n)))


def slow_scores(text, term, hedges, markers, before, around):
    out = [0, 0, 0]
    for m in re.finditer(term, text, re.I | re.S):
        hedged = bool(re.search(hedges, text[max(0, m.start() - before) : m.start()], re.I))
        actual = bool(re.search(markers, text[max(0, m.start() - around) : m.end() + around], re.I))
        out[0] += 1
        out[1] += actual and not hedged
        out[2] += hedged
    return tuple(out)


def test_mentions(spark):
    term = texts.FILING_TERMS["warning_letter"]
    df = spark.createDataFrame([("they may receive a warning letter",), ("we received a warning letter",), ("",), (None,)], "t string")
    rows = df.select(texts.mention_scores(F.col("t"), term).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in rows[:3]] == [(1, 0, 1), (1, 1, 0), (0, 0, 0)]


def test_mentions_against_a_plain_loop(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["x", "x", "hh", "mm", "filler", "y\n"]) for _ in range(rng.randint(0, 60))),) for _ in range(150)]
    got = spark.createDataFrame(rows, "t string").select(texts.mention_scores(F.col("t"), r"\bx\b", r"\bhh\b", r"\bmm\b", 9, 25).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [slow_scores(t, r"\bx\b", r"\bhh\b", r"\bmm\b", 9, 25) for (t,) in rows]
    monkeypatch.setattr(texts, "BLOCK_CHARS", 40)  # windows and matches over several blocks
    rows = [(" ".join(rng.choice(["x", "x" + " " * 90 + "x", "hh", "mm", "🙂é", "y\n"]) for _ in range(rng.randint(0, 60))),) for _ in range(60)]
    got = spark.createDataFrame(rows, "t string").select(texts.mention_scores(F.col("t"), r"\bx(?: {80,}x)?\b", r"\bhh\b", r"\bmm\b", 9, 25).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [slow_scores(t, r"\bx(?: {80,}x)?\b", r"\bhh\b", r"\bmm\b", 9, 25) for (t,) in rows]


def test_letters(spark):
    kind = lambda t: one(spark, texts.letter_type(F.col("v")), v=t)
    assert kind("WARNING LETTER\nDear") == "warning letter"
    assert kind("FDA has completed an evaluation of your firm's corrective actions in response to our Warning Letter") == "close-out letter"
    assert kind("Response Letter\nto a warning letter") == "response letter"
    assert kind("CLOSEOUT LETTER\nWARNING LETTER\nDear") == "warning letter"
    assert kind("we discuss a warning letter") == "unknown"
    assert kind("Hello") == "unknown"
    title = one(spark, texts.title_line(F.col("v")), v="Acme Corp 3/4/05\nbody")
    assert (title.company, title.dated) == ("Acme Corp", date(2005, 3, 4))
    assert one(spark, texts.without_archive_mark(F.col("v")), v="Acme [ARCHIVED]") == "Acme"
    assert one(spark, texts.printed_id(F.lit("ref 12345."), F.lit(12345)), v="") is True
    assert one(spark, texts.printed_id(F.lit("ref 912345."), F.lit(12345)), v="") is False


def test_patterns_are_passed_once_over_a_text(spark):
    """Neither a filter on flags nor the sections repeat a pattern over the whole text, and what leads to a match changes none."""
    import re

    from ledgerloom.plans import composites

    docs = spark.createDataFrame([(0, "10-K", "3841", "x")], "doc_id int, form string, sic string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    classified = plan(composites.device_set(composites.classify_filings(docs)))
    assert classified.count("cGMP") == 1 and classified.count("infusion") == 2  # the latter over the text and over its lead
    assert len(re.findall(r"regexp_extract_all\([^,]*text[^,]*, [^,]*item", plan(composites.score_filings(docs)))) == 2  # one a form
    vocabularies = [*texts.EVENT_PHRASES.values(), texts.REGULATOR, *texts.DOMAIN_TERMS.values(), *texts.FILING_TERMS.values(), texts.ACTUAL_MARKERS, texts.LOCAL_HEDGES]
    said = "No recall. The RECALL of class II recall; 510(k) and MDR report, BLA; our recall during the year may close: closed, 21 CFR 820 vials"
    for pattern in vocabularies:
        assert texts.led(pattern).startswith("(?=[")
        want = [m.group() for m in re.finditer("(?i)" + pattern.removeprefix("(?i)"), said)]
        got = spark.sql("SELECT 1").select(F.regexp_extract_all(F.lit(said), F.lit(texts.led(pattern, "(?i)")), F.lit(0)).alias("x")).first().x
        assert got == want
    assert texts.led(r"(?i)^a|b") == "(?i)(?:^a|b)" and texts.led(r"a?b") == "(?:a?b)" and texts.led(r"ab") == "(?=[Aa])(?:ab)"
