"""Import checks, plausibility, and extraction from pages."""

import random

from frames import rows
from pyspark.sql import functions as F

from canvasser.operators import extract, quality


def test_mapping(spark):
    assert quality.auto_map_columns([" Email Address ", "Name", "ZIP", "Shoe"], "schools") == {" Email Address ": "email", "Name": "name", "ZIP": "zipCode"}
    assert quality.auto_map_columns(["name"], "contacts") == {"name": "firstName"}
    raw = spark.createDataFrame([(1, "a", " b ", "x")], "row int, `first name` string, Name string, other string")
    mapping = quality.auto_map_columns(["first name", "Name", "other"], "contacts")
    assert rows(quality.map_row(raw, mapping, ["row"])) == [(1, "b")]


def test_validation(spark):
    cols = "row int, firstName string, lastName string, email string, schoolId string"
    data = spark.createDataFrame(
        [(0, "A", "B", "a@x.y", "ALPHA"), (1, "", None, "", ""), (2, "A", "B", "nope", "Nowhere"), (3, "A", "B", "OLD@x.y", "")], cols
    )
    contacts = spark.createDataFrame([("old@X.y",)], "email string")
    schools = spark.createDataFrame([("Alpha",)], "name string")
    issues = quality.validate_contacts(data, contacts, schools)
    assert rows(issues) == [
        (1, "email", "Missing email", "error"), (1, "firstName", "Missing first name", "error"), (1, "lastName", "Missing last name", "error"),
        (2, "email", "Invalid email format", "error"), (2, "schoolId", 'School "Nowhere" not found — row will be skipped', "error"),
        (3, "email", "Duplicate email (already exists)", "warning"),
    ]
    assert rows(quality.clean_rows(data, issues), "row") == [(0,), (3,)]
    incoming = spark.createDataFrame([(0, "alpha", "Cook"), (1, "", "")], "row int, name string, county string")
    assert [r[1:] for r in rows(quality.validate_schools(incoming, schools))] == [
        ("name", "School already exists — will be skipped", "warning"), ("county", "Missing county", "error"), ("name", "Missing school name", "error")
    ]
    assert rows(quality.duplicate_names(incoming, schools), "row") == [(0,)]


def test_reasons(spark):
    names = [("", "T"), ("Al", None), ("J. R. R. T. Smith", "x"), ("Lincoln High 2", "x"), ("Ann Lee", " ")]
    df = spark.createDataFrame(names, "name string, title string")
    got = [r[0] for r in df.select(quality.contact_unlikely_reasons(F.col("name"), F.col("title"))).collect()]
    assert got == [
        ["name is empty"], ["name has too few letters", "missing title"], ["name has too many tokens"],
        ["name contains digits", "name looks like organization text"], ["missing title"],
    ]
    recs = spark.createDataFrame(
        [("late", ["c"], [], True), (None, ["c"], [], True), (None, ["c"], None, False), (None, [], [], False), (None, None, ["p"], True)],
        "error string, contacts array<string>, pages array<string>, has_urls boolean",
    )
    got = [r[0] for r in recs.select(quality.school_unlikely_reasons(*[F.col(c) for c in recs.columns])).collect()]
    assert got == [[], ["contacts found but pages_with_contacts is empty"], ["school_urls is missing"], [], ["contacts is not a list"]]


def test_quarantine(spark):
    flagged = spark.createDataFrame([(1, ["r"]), (2, ["r"]), (3, [])], "id int, reasons array<string>")
    votes = spark.createDataFrame([(1, "error"), (2, "keep"), (3, "error")], "id int, decision string")
    kept, errors = quality.quarantine(flagged, votes, ["id"])
    assert rows(kept, "id") == [(2,), (3,)] and rows(errors, "id") == [(1,)]


def test_signals(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.org, (618) 555-1234 x 5 or 1-618-555-9999; Send  Email"), (2, "none"), (3, None)], "id int, t string")
    assert rows(extract.extract_signals(docs, "id", "t")) == [
        (1, "email", 0, "a.b@x.org"), (1, "message", 0, "Send  Email"), (1, "phone", 0, "(618) 555-1234 x 5"), (1, "phone", 1, "1-618-555-9999")
    ]


PAGE = """<html><body><script>var a = "x@y.org";</script>
<ul><li><p>JANE doe</p><p>To the team</p><p>Principal</p><p>Main Office</p><p>618-555-1234</p><a href="MAILTO:Jane@A.org?subject=x">Email</a></li>
<li><p>Bob Roe</p><p>Student Services</p><a href="mailto:bob@a.org">bob@a.org</a></li>
<li><p>Cat Poe</p><p>Dean</p><button>Send Message</button></li>
<li><p>Cat Poe</p><p>Dean</p><button>Send Message</button></li></ul>
<div class="pagination"><a href="/p2">more</a></div><a rel="next" href="https://o.org/n">x</a><a href="#a">2</a><a href="q?page=3">3</a>
<li class="next"><a href="/p2">again</a></li></body></html>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, "https://a.org/staff", PAGE), (2, "u", None), (3, "u", "<p>x</p>")], "page_id bigint, url string, html string")
    blocks = extract.extract_blocks(pages)
    assert sorted(r.lines[0] for r in blocks.collect()) == ["Bob Roe", "Cat Poe", "JANE doe"]
    got = rows(extract.assign_fields(blocks), "name", "title", "dept", "phone", "email")
    # "Student Services" holds "es", so as a whole-line text it is no title here.
    assert got == [("Cat Poe", "Dean", "", "", ""), ("Jane Doe", "Principal", "Main Office", "618-555-1234", "jane@a.org")]
    assert rows(extract.pagination_links(pages), "ord", "target") == [(0, "https://a.org/p2"), (1, "https://o.org/n"), (2, "https://a.org/q?page=3")]


def test_signals_behind_character_references(spark):
    card = "<div><p>Ann Lee</p><p>Dean</p><p>{}</p></div>"
    texts = ["a&#64;b.org", "a&commat;b.org", "Send &#101;mail", "nothing"]
    pages = spark.createDataFrame([(i, "u", card.format(t)) for i, t in enumerate(texts)], "page_id bigint, url string, html string")
    got = rows(extract.assign_fields(extract.extract_blocks(pages)), "page_id", "name", "email")
    assert got == [(0, "Ann Lee", "a@b.org"), (1, "Ann Lee", "a@b.org"), (2, "Ann Lee", "")]


def test_titles_and_links(spark):
    df = spark.createDataFrame([("Student Services",), ("Assistant Principal",), ("DEAN",), ("Deanery",), (None,)], "x string")
    got = [tuple(r) for r in df.select(extract.title_match(F.col("x")), extract.title_match(F.col("x"), "word")).collect()]
    assert got == [(False, True), (False, False), (True, True), (True, False), (None, None)]
    links = spark.createDataFrame([("mailto:a@b.c?x",), ("SendTo: q ",), ("http://mailto:x",), ("mailto:?s",)], "h string")
    assert [r[0] for r in links.select(extract.link_email(F.col("h"))).collect()] == ["a@b.c", "q", None, None]


def test_text_contacts(spark):
    blocks = spark.createDataFrame(
        [(1, ["- Ann Lee Roy Dean", "Title: counselor", "x@y.org"]), (2, ["Bo", "618-555-1234 principal", "a", "b", "Principal"]), (3, ["Title", "Dept"])],
        "page_id int, lines array<string>",
    )
    assert rows(extract.text_contact(blocks), "page_id", "name", "title", "phone", "email") == [
        (1, "Ann Lee", "Roy Dean", None, "x@y.org"), (2, "Bo", None, "618-555-1234", None)
    ]


def test_fallback_and_outcomes(spark):
    first = spark.createDataFrame([("s1", "p2", "a"), ("s1", "p1", "b")], "school string, page_url string, name string")
    second = spark.createDataFrame([("s1", "p9", "no"), ("s2", "p3", "c"), ("s2", "p3", "d")], "school string, page_url string, name string")
    records, pages = extract.contacts_with_fallback(first, second)
    assert rows(records, "school", "name") == [("s1", "a"), ("s1", "b"), ("s2", "c"), ("s2", "d")]
    assert rows(pages) == [("s1", "p1"), ("s1", "p2"), ("s2", "p3")]
    sites = spark.createDataFrame([("s1",), ("s9",)], "school string")
    assert rows(extract.split_outcomes(sites, records)) == [("s1", 2, "completed"), ("s9", 0, "still_working")]
    docs = spark.createDataFrame([(1, "Total Enrollment: 1,234 and enrollment: 5"), (2, "none")], "id int, t string")
    assert rows(extract.extract_enrollment(docs, "id", "t")) == [(1, 1234), (2, None)]


def test_signatures(spark):
    cards = [("s", 1, i, "a") for i in range(4)] + [("s", 2, 10 + i, x) for i, x in enumerate(["b", "c", "c", "", "d", "b"])] + [("s", 3, 20 + i, "z") for i in range(9)]
    df = spark.createDataFrame(cards, "site string, page_ord int, block_ord int, signature string")
    assert rows(extract.dominant_signatures(df), "rank", "signature", "blocks") == [(1, "b", 2), (2, "c", 2)]


def test_form_errors(spark):
    df = spark.createDataFrame([("N", "C", "", "x", "IL", "1234")], "name string, county string, address string, city string, state string, zip_code string")
    assert df.select(quality.school_form_errors()).first()[0] == ["address", "zip_code"]


def test_no_break_spaces_and_letter_case(spark):
    """White space, digits and case count as Unicode has them."""
    text = "Call (618) 555 1234 or +1 217-555-0000. Enrollment: 1,234"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert [r.value for r in extract.extract_signals(df, "k", "t").collect()] == ["(618) 555 1234", "+1 217-555-0000"]
    assert extract.extract_enrollment(df, "k", "t").first().enrollment == 1234
    blocks = spark.createDataFrame([(1, "u", 0, "", ["(618) 555 1234", "Ann Lee", "Principal"])], "page_id long, url string, signal int, link_email string, lines array<string>")
    row = extract.assign_fields(blocks).first()
    assert (row.name, row.phone, row.dept) == ("Ann Lee", "(618) 555 1234", "")


def test_page_filter_keeps_every_page_with_a_signal(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    parts = ["<a href='x'>", "</a>", "Email", "Emaıl", "EMAİL", "meſſage", "MESSAGE", "a@b.org", "&commat;", "&#64;", "mailto:", "SENDTO:", "<p>", "plain ", "<li>", "K"]
    pages: list[str] = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(st.sampled_from(parts), max_size=8))
    def collect(chosen):
        pages.append("<html><div>one<br>two<div>" + "".join(chosen) + "</div></div></html>")

    collect()
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    kept = {r.k for r in df.filter(extract._may_signal("html")).collect()}
    assert {k for k, page in enumerate(pages) if extract._signals(extract._Tree(page).root)} <= kept


def test_page_filter_against_random_references(spark):
    """Signals spelt with named and numeric references, as the parser reads them."""
    from html.entities import html5

    rnd = random.Random(11)
    spelt: dict[str, list[str]] = {}
    for name, value in html5.items():
        spelt.setdefault(value, []).append("&" + name)
    folded = {"i": "iıIİ", "k": "kK\u212a", "s": "sS\u017f"}
    words = ["email", "message", "a@b.org", "mailto:x", "sendto:y", "plain", "&amp;", "fish&nbsp;chips"]

    def spell(ch):
        ch = rnd.choice(folded.get(ch, ch + ch.upper()))
        refs = [*spelt.get(ch, []), f"&#{ord(ch)};", f"&#x{ord(ch):X};"]
        return rnd.choice(refs) if rnd.random() < 0.25 else ch

    pages = []
    for k in range(600):
        text = "".join(w if w[0] == "&" or "&" in w else "".join(map(spell, w)) for w in rnd.choices(words, k=2))
        pages.append(f"<div>one<br>two<p>{text}</p></div>" if k % 2 else f"<div>one<br>two<a href='{text}'>x</a></div>")
    pages += ["<p>Ema&imath;l me</p>", "<a href='mailto&colon;office'>x</a>"]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    kept = {r.k for r in df.filter(extract._may_signal("html")).collect()}
    told = {k for k, page in enumerate(pages) if extract._signals(extract._Tree(page).root)}
    assert told <= kept and {600, 601} <= told and len(told) > 150 and len(kept) < len(pages)


def test_site_contacts_parse_a_page_once(spark, monkeypatch):
    card = "<div class='c'><img><p>{0} Doe</p><p>Principal</p><a href='mailto:{0}@x.org'>write</a></div>"
    # A title that stands alone on no line: only the second extractor reads it.
    rough = "<div class='c'><img><p>{0} Doe Dean</p><span>x</span><p>the dean's deputy of everything, Services</p><a href='mailto:{0}@x.org'>write</a></div>"
    many = lambda shape, names: "<html>" + "".join(shape.format(n) for n in names) + "<a rel='next' href='/2'>n</a></html>"
    pages = [
        (1, "https://a.org/p", many(card, ["Ann", "Bo"])), (2, "https://b.org/p", many(rough, ["Cy", "Di", "Ed", "Flo", "Gus"])),
        (3, "https://c.org/p", "<p>no signal</p>"), (4, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    records, found, pagers = extract.site_contacts(df, host)
    assert rows(pagers) == [(1, 0, "https://a.org/2"), (2, 0, "https://b.org/2")]
    first = extract.assign_fields(extract.extract_blocks(df)).select(host.alias("school"), "page_id", "name", "email")
    second = extract.card_contacts(extract.extract_cards(df), host).select(F.col("site").alias("school"), "page_id", "name", "email")
    seen = {r.school for r in first.collect()}
    want = [tuple(r) for r in first.collect()] + [tuple(r) for r in second.collect() if r.school not in seen]
    assert sorted(rows(records, "school", "page_id", "name", "email")) == sorted(want)
    assert rows(found) == sorted({(s, f"{s}/p") for s, *_ in want})
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # both extractors read the stored parse
    assert extract.parse_pages(df)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_whole_results_in_quarantine(spark):
    schools = spark.createDataFrame(
        [("A", None, None, [], ["school_urls is missing"]), ("B", "b", "alt", ["/p"], [])],
        "school string, base_url string, alt_url string, pages_with_contacts array<string>, reasons array<string>",
    )
    contacts = spark.createDataFrame([("A", 0, "x", ["r"]), ("B", 0, "y", ["r"]), ("B", 1, "z", [])], "school string, pos int, name string, reasons array<string>")
    votes = spark.createDataFrame([("A", "error"), ("B", "error")], "school string, decision string")
    places = spark.createDataFrame([("A", 0, "error"), ("B", 0, "error"), ("B", 1, "error")], "school string, pos int, decision string")
    kept, people, errors = quality.quarantine_results(schools, contacts, ["school"], "pos", votes, places)
    assert rows(kept, "school") == [("B",)] and rows(people, "name") == [("z",)]
    got = {r.flag_type: r for r in errors.collect()}
    assert got["school_result"].school == "A" and got["contact"].base_url == "b" and '"name":"y"' in got["contact"].record


def test_cards_need_a_picture_until_the_site_has_a_usual_class(spark):
    card = "<div class='{0}'>{1}<p>{2} Doe</p><p>Principal</p><a href='mailto:{2}@x.org'>write</a></div>"
    few = "<html>" + card.format("odd", "<img>", "Ann") + card.format("none", "", "Bo") + "</html>"
    many = "<html>" + "".join(card.format("c", "<img>", f"P{k}") for k in range(5)) + card.format("c", "", "Cy") + card.format("odd", "<img>", "Di") + "</html>"
    pages = spark.createDataFrame([(1, "u", few), (2, "u", many), (3, "u", few), (4, "u", None)], "page_id long, url string, html string")
    got = extract.card_contacts(extract.extract_cards(pages), F.col("url"))
    names = [(1, "Ann Doe"), *[(2, f"P{k} Doe") for k in range(5)]]
    assert [x for x in rows(got, "page_id", "name") if x[1] not in ("Cy Doe", "Di Doe")] == names
    assert (2, "Cy Doe") in rows(got, "page_id", "name")


def test_pages_of_one_file_are_parsed_by_several_tasks(spark, table):
    html = "<html><body><div><p>Ann Lee</p><p>Principal</p><p>a@x.example.org</p></div></body></html>"
    pages = table([(k, "https://x.example.org", html) for k in range(200)], "page_id bigint, url string, html string").coalesce(1)
    parsed = extract.parse_pages(pages, ("block",))
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
