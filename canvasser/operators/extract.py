"""Contact extraction from fetched pages.

A small Python helper turns one page into the text lines around each contact signal; choosing
the block, assigning fields, matching titles and removing repeats are Spark expressions over
those lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvasser import schema as M
from canvasser.functions import text as X
from canvasser.session import fresh_path

# White space, digits and letter case as Unicode has them, so that a no-break space counts.
_MESSAGE = f"(?iU){M.MESSAGE_PATTERN}"
_PHONE = f"(?U){M.PHONE_PATTERN}"
_EMAIL = f"(?U){M.EMAIL_PATTERN}"


def extract_signals(df: DataFrame, key: str, text: str) -> DataFrame:
    """All e-mails, phones and message markers of a text: (key, kind, ord, value)."""
    def found(kind: str, pattern: str, possible: Column) -> Column:
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.when(possible, F.struct(F.lit(kind).alias("kind"), hits.alias("values")))

    # Cheap necessary conditions keep the expensive patterns off most texts.
    kinds = F.array(
        found("email", _EMAIL, F.col(text).contains("@")),
        found("phone", _PHONE, F.col(text).rlike(r"(?U)\d{4}")),
        found("message", _MESSAGE, F.col(text).rlike("(?iU)email|message")),
    )
    rows = df.select(key, F.inline(F.array_compact(kinds)))
    return rows.select(key, "kind", F.posexplode("values").alias("ord", "value"))


# --- pages to lines -----------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "template"}
_EMAIL_RE, _MESSAGE_RE = re.compile(M.EMAIL_PATTERN), re.compile(M.MESSAGE_PATTERN, re.I)


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self) -> "Iterator[_Node | str]":
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, _Node):
                stack.extend(reversed(node.items))

    def lines(self) -> list[str]:
        texts = (x for x in self.walk() if isinstance(x, str))
        return [line.strip() for t in texts for line in t.split("\n") if line.strip()]


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.items.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.items.append(_Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        if self.here.tag not in _SKIP:
            self.here.items.append(data)


def _signals(root: _Node) -> list[tuple[_Node, str]]:
    """Elements that point at a contact, in order of kind, with the e-mail they carry."""
    texts, links, buttons = [], [], []
    for x in root.walk():
        if isinstance(x, str):
            continue
        texts.extend((x, t) for t in x.items if isinstance(t, str))
        if x.tag == "a":
            links.append(x)
        elif x.tag == "button":
            buttons.append(x)
    out = [(node, m.group(0)) for node, t in texts if (m := _EMAIL_RE.search(t))]
    out += [(node, "") for node, t in texts if _MESSAGE_RE.search(t) and not _EMAIL_RE.search(t)]
    for scheme in ("sendto:", "mailto:"):
        out += [(a, "") for a in links if scheme in a.attrs.get("href", "").lower()]
    out += [(x, "") for x in links + buttons if _MESSAGE_RE.search(" ".join(x.lines()))]
    return out


def _link_target(node: _Node) -> str:
    href = node.attrs.get("href", "").strip()
    scheme, _, rest = href.partition(":")
    return rest.split("?", 1)[0].strip() if scheme.lower() in ("mailto", "sendto") else ""


def page_blocks(root: _Node) -> Iterator[tuple[int, int, str, list[str]]]:
    """(signal, level, e-mail of the link, lines) for each enclosing element of 2 to 10 lines."""
    cache: dict[int, list[str]] = {}
    for n, (node, mail) in enumerate(_signals(root)):
        mail = _link_target(node) or mail
        for level in range(8):
            if id(node) not in cache:
                kept = node.lines()
                cache[id(node)] = [r for r in kept if not _MESSAGE_RE.search(r) and not r.lower().startswith("to ")]
            lines = cache[id(node)]
            if len(lines) > 10:  # an enclosing element never has fewer lines
                break
            if len(lines) >= 2:
                yield n, level, mail, lines
            node = node.parent
            while node is not None and node.tag not in M.BLOCK_TAGS:
                node = node.parent
            if node is None:
                break


# One row per part of a page: a level of a block (ord: signal), a card (ord: place), a pager.
PARTS = ("block", "card", "pager")
PARSED = "page_id bigint, url string, part string, ord int, level int, signature string, candidate boolean, link_email string, target string, lines array<string>"


def _page_parts(url: str, html: str, telling: bool, wanted: Sequence[str]) -> Iterator[tuple]:
    """The parts of a page from one parse; pages without a signal have neither blocks nor cards."""
    if not telling and "pager" not in wanted:
        return
    root = _Tree(html).root
    if telling and "block" in wanted:
        for n, level, mail, lines in page_blocks(root):
            yield "block", n, level, None, None, mail, None, lines
    if telling and "card" in wanted:
        for place, signature, candidate, mail, lines in page_cards(root):
            yield "card", place, None, signature, candidate, mail, None, lines
    if "pager" in wanted:
        for n, target in enumerate(page_pagers(url, root)):
            yield "pager", n, None, None, None, None, target, None


def parse_pages(pages: DataFrame, wanted: Sequence[str] = PARTS) -> DataFrame:
    """The wanted parts of every page (columns ``PARSED``); each page is parsed once."""
    columns = [c.split()[0] for c in PARSED.split(", ")]
    telling = _may_signal("html")
    if "pager" in wanted:
        rows = pages.withColumn("_telling", F.coalesce(telling, F.lit(False)))
    else:
        rows = pages.filter(telling).withColumn("_telling", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for pdf in batches:
            for page_id, url, html, told in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["_telling"]):
                found.extend((page_id, url, *part) for part in _page_parts(url or "", html or "", bool(told), wanted))
                if len(found) >= 5000:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
        if found:
            yield pd.DataFrame(found, columns=columns)

    # Parsing costs far more than reading and a small file is one task, so pages are dealt out first,
    # in a given number of parts, as similar pages shrink to so few bytes that these would be joined.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("page_id", "url", "html", "_telling").repartition(parts, F.xxhash64("page_id", "url", "html"))
    return dealt.mapInPandas(run, PARSED)


def _term_pattern(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms)


def title_match(line: Column, mode: str = "substring") -> Column:
    """Whether a line is a job title of interest.

    ``substring`` looks for the words anywhere in the line (so "es" rejects "Services"),
    ``word`` at word boundaries.
    """
    wanted, unwanted = _term_pattern(M.TITLE_TERMS), _term_pattern(M.TITLE_REJECTS)
    if mode == "word":
        wanted, unwanted = rf"\b(?:{wanted})\b", rf"\b(?:{unwanted})\b"
    low = F.lower(line)
    return low.rlike(wanted) & ~low.rlike(unwanted)


def _spells(value: str) -> bool:
    """Whether a character may be part of what a signal is told by: "@", ":" or a letter of a-z in any case."""
    return any(c in "@:" or any(x[:1].isascii() and x[:1].isalpha() for x in (c.lower(), c.upper(), c.casefold())) for c in value)


# Names of the character references that can spell a part of a signal.
_SPELLING = "|".join(sorted({name.rstrip(";") for name, value in html5.items() if _spells(value)}))


def _may_signal(html: str) -> Column:
    """Necessary condition for a contact signal, so that other pages are never parsed.

    Letter case is folded as the parser folds it, by Unicode. Numeric character references could
    spell any part of a signal, and so could some named ones.
    """
    page = F.col(html)
    possible = page.rlike("(?iU)email|message|mailto:|sendto:") | page.rlike(f"&(?:{_SPELLING})")
    for mark in ("@", "&#"):
        possible = page.contains(mark) | possible
    return possible


def extract_blocks(pages: DataFrame) -> DataFrame:
    """``blocks_of`` the pages alone."""
    return blocks_of(parse_pages(pages, ("block",)))


def blocks_of(parsed: DataFrame) -> DataFrame:
    """One block of lines per signal and page: (page_id, url, signal, link_email, lines).

    Climbing from the signal, the first enclosing element with an e-mail, phone or title word
    ends the search, else the outermost one counts. Equal blocks of a page are kept once.
    """
    levels = parsed.filter("part = 'block'").select("page_id", "url", F.col("ord").alias("signal"), "level", "link_email", "lines")
    terms = _term_pattern(M.TITLE_TERMS)
    telling = F.exists(
        "lines",
        lambda x: x.rlike(_EMAIL) | x.rlike(_PHONE) | F.lower(x).rlike(terms),
    )
    # At most eight levels per signal: min/max aggregates, no list per page.
    levels = levels.withColumn("_stop", telling)
    pick = F.struct("level", "lines", "link_email", "url")
    chosen = levels.groupBy("page_id", "signal").agg(
        F.min(F.when(F.col("_stop"), pick)).alias("_hit"), F.max(pick).alias("_last")
    )
    chosen = chosen.withColumn("_b", F.coalesce("_hit", "_last"))
    blocks = chosen.select("page_id", F.col("_b.url").alias("url"), "signal", F.col("_b.link_email").alias("link_email"), F.col("_b.lines").alias("lines"))
    return blocks.groupBy("page_id", "lines").agg(F.min(F.struct("signal", "url", "link_email")).alias("s")).select(
        "page_id", "s.url", "s.signal", "s.link_email", "lines"
    )


def _evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator of one row, so that the optimizer does not copy their
    expressions into every place that uses them (such as a lambda run per array element)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def assign_fields(blocks: DataFrame) -> DataFrame:
    """Contact fields of each block; blocks without a title are dropped.

    Lines are taken in order: the first one with an e-mail gives the e-mail, the first other
    one with a phone the phone, the first other title line the title, the first plain line
    left the name; the first plain line that is neither name nor title is the department.
    """
    line = F.transform(
        "lines",
        lambda x: F.struct(
            x.alias("x"),
            x.rlike(_EMAIL).alias("mail"),
            x.rlike(_PHONE).alias("phone"),
            title_match(x).alias("title"),
            x.rlike(_MESSAGE).alias("noise"),
        ),
    )
    df = _evaluated_once(blocks, _lines=line)
    empty = F.lit(None).cast("string")
    start = F.struct(*[empty.alias(c) for c in ("mail", "phone", "title", "name")])
    plain = lambda r: ~r["mail"] & ~r["phone"] & ~r["noise"]

    def step(found: Column, r: Column) -> Column:
        as_mail = found["mail"].isNull() & r["mail"]
        as_phone = ~as_mail & found["phone"].isNull() & r["phone"]
        as_title = ~as_mail & ~as_phone & found["title"].isNull() & r["title"]
        as_name = ~as_mail & ~as_phone & ~as_title & found["name"].isNull() & plain(r)
        takes = {"mail": as_mail, "phone": as_phone, "title": as_title, "name": as_name}
        return F.struct(*[F.when(take, r["x"]).otherwise(found[c]).alias(c) for c, take in takes.items()])

    df = _evaluated_once(df, _f=F.aggregate("_lines", start, step)).filter("_f.title is not null")
    name = F.coalesce("_f.name", F.lit(""))
    rest = F.filter("_lines", lambda r: plain(r) & (r["x"] != name) & (r["x"] != F.col("_f.title")))
    mail = X.blank_to_null(F.regexp_extract(F.col("_f.mail"), _EMAIL, 0))
    return df.select(
        "page_id", "url", "signal",
        X.word_title(name).alias("name"),
        X.word_title("_f.title").alias("title"),
        X.word_title(F.get(rest, F.lit(0))["x"]).alias("dept"),
        F.coalesce(X.strip(F.regexp_extract(F.col("_f.phone"), _PHONE, 0)), F.lit("")).alias("phone"),
        F.lower(F.trim(F.coalesce(mail, "link_email", F.lit("")))).alias("email"),
    )


def link_email(href: Column) -> Column:
    """Address of a mailto: or sendto: link, up to the question mark; null for other links."""
    return X.blank_to_null(F.trim(F.regexp_extract(F.trim(href), r"(?i)^(?:mailto|sendto):([^?]*)", 1)))


def _is_pager(node: _Node) -> bool:
    def classes(x: _Node) -> list[str]:
        return x.attrs.get("class", "").split()

    if node.attrs.get("rel", "") == "next" or "next" in node.attrs.get("aria-label", "").lower() or "next" in classes(node):
        return True
    label = " ".join(node.lines()).lower()
    if label.isdigit() or label == "next":
        return True
    up = node.parent
    while up is not None:
        if "pagination" in classes(up) or (up.tag == "li" and "next" in classes(up)):
            return True
        if up.tag == "nav" and "pagination" in up.attrs.get("aria-label", "").lower():
            return True
        up = up.parent
    return False


def page_pagers(url: str, root: _Node) -> list[str]:
    """Absolute targets of the paging links of a page, first-seen order."""
    anchors = (x for x in root.walk() if isinstance(x, _Node) and x.tag == "a")
    hrefs = (a.attrs.get("href", "").strip() for a in anchors if _is_pager(a))
    return list(dict.fromkeys(urljoin(url, h) for h in hrefs if h and not h.startswith("#")))


def pagination_links(pages: DataFrame) -> DataFrame:
    return pagers_of(parse_pages(pages, ("pager",)))


def pagers_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("part = 'pager'").select("page_id", "ord", "target")


def contacts_with_fallback(first: DataFrame, second: DataFrame, site: str = "school") -> tuple[DataFrame, DataFrame]:
    """Per site the records of the first extractor, or of the second where it found none.

    Also returns the pages with records, one row each. Both inputs have (school, page_url, ...).
    """
    spare = second.join(first.select(site).distinct(), site, "left_anti")
    records = first.unionByName(spare)
    return records, records.select(site, "page_url").distinct()


def extract_enrollment(df: DataFrame, key: str, text: str, pattern: str = M.ENROLLMENT_PATTERN) -> DataFrame:
    """First enrolment figure of each text, null where there is none."""
    digits = F.regexp_replace(F.regexp_extract(F.col(text), f"(?iU){pattern}", 1), ",", "")
    return df.select(key, digits.try_cast("int").alias("enrollment"))


def split_outcomes(sites: DataFrame, records: DataFrame, site: str = "school") -> DataFrame:
    """Sites with their outcome: completed with records, still_working without."""
    counts = records.groupBy(site).agg(F.count("*").alias("n_records"))
    joined = sites.join(counts, site, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    return joined.withColumn("outcome", F.when(F.col("n_records") > 0, "completed").otherwise("still_working"))


def text_contact(blocks: DataFrame) -> DataFrame:
    """Rule part of the second extractor over blocks (page_id, lines).

    Lines lose the words "title" and "dept" and surrounding dashes and colons. The name is
    the first two words of the first line; the title is the first title line among the three
    behind the name line, leaving out lines with a phone or e-mail. What follows the second
    word of the name line counts as the line behind it.
    """
    def tidy(x: Column) -> Column:
        squeezed = F.btrim(X.squeeze(x), F.lit(" -:"))
        words = F.filter(F.split(squeezed, " "), lambda w: (w != "") & ~F.lower(w).isin("title", "dept"))
        return F.array_join(words, " ")

    df = blocks.withColumn("_t", F.filter(F.transform("lines", tidy), lambda x: x != "")).filter(F.size("_t") > 0)
    words = F.split(F.get("_t", F.lit(0)), " ")
    name = F.array_join(F.slice(words, 1, 2), " ")
    rest = F.array_join(F.slice(words, 3, F.size(words)), " ")
    tail = F.slice("_t", 2, 3)
    after = F.slice(F.when(rest != "", F.concat(F.array(rest), tail)).otherwise(tail), 1, 3)
    title = F.get(
        F.filter(
            after,
            lambda x: ~x.rlike(_PHONE) & ~x.rlike(_EMAIL) & title_match(x, "word"),
        ),
        F.lit(0),
    )
    whole = F.array_join("lines", "\n")
    grab = lambda p: X.blank_to_null(F.regexp_extract(whole, p, 0))
    return df.select(
        "page_id", name.alias("name"), title.alias("title"),
        grab(_PHONE).alias("phone"), grab(_EMAIL).alias("email"),
    )


# --- cards: the second extractor ------------------------------------------------------------


def _card_starts(root: _Node) -> list[tuple[_Node, str]]:
    """Where the search for a card begins: elements at a contact signal, with the address of a mail link."""
    out = []
    for x in root.walk():
        if isinstance(x, str):
            continue
        texts = [t for t in x.items if isinstance(t, str)]
        if any(_EMAIL_RE.search(t) for t in texts):
            out.append((x.parent, _link_target(x)))
        if any(_MESSAGE_RE.search(t) for t in texts):
            out.append((x, _link_target(x)))
        if x.tag == "a" and (
            x.attrs.get("href", "").startswith("mailto:") or _MESSAGE_RE.search(x.attrs.get("onclick", "")) or _MESSAGE_RE.search(" ".join(x.lines()))
        ):
            out.append((x.parent, _link_target(x)))
    return out


def page_cards(root: _Node) -> Iterator[tuple[int, str, bool, str, list[str]]]:
    """(place, class signature, candidate, mail address, lines) of the elements that may hold one person.

    A candidate is the first of up to eight enclosing elements of a signal that holds an image
    and is neither the page nor a paragraph without a class. Other elements with a class come
    along, as those of the site's usual class are cards too.
    """
    nodes = [x for x in root.walk() if isinstance(x, _Node)]
    place = {id(x): k for k, x in enumerate(nodes)}
    pictured = set()
    for x in nodes:
        if x.tag == "img":
            up = x.parent
            while up is not None and id(up) not in pictured:
                pictured.add(id(up))
                up = up.parent
    signature = lambda x: " ".join(sorted(x.attrs.get("class", "").split()))
    found: dict[int, str] = {}
    for node, mail in _card_starts(root):
        for _ in range(8):
            if node is None or node.tag in ("", "html"):
                break
            if id(node) in pictured and not (node.tag == "p" and not signature(node)):
                found[id(node)] = found.get(id(node)) or mail
                break
            node = node.parent
    for x in nodes:
        if id(x) in found or signature(x):
            yield place[id(x)], signature(x), id(x) in found, found.get(id(x), ""), x.lines()


def extract_cards(pages: DataFrame) -> DataFrame:
    return cards_of(parse_pages(pages, ("card",)))


def cards_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("part = 'card'").select("page_id", "url", F.col("ord").alias("block_ord"), "signature", "candidate", "link_email", "lines")


def site_contacts(pages: DataFrame, site: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From fetched pages to contacts: records (school, page_url, page_id, name, title, phone, email), pages with records, pagers.

    The first extractor takes blocks around signals, the second one cards for the sites where the
    first found none. Both and the pagers work on one parse of each page, which is stored.
    """
    path = fresh_path(pages.sparkSession, "parsed")
    parse_pages(pages).write.parquet(path)
    parsed = pages.sparkSession.read.parquet(path)
    columns = ["school", "page_url", "page_id", "name", "title", "phone", "email"]
    first = assign_fields(blocks_of(parsed)).select(site.alias("school"), F.col("url").alias("page_url"), "page_id", "name", "title", "phone", "email")
    cards = cards_of(parsed)
    second = card_contacts(cards, site).withColumnRenamed("site", "school")
    # A page's address belongs to its id; equal contacts of a site stand at their first page.
    where = cards.select("page_id", F.col("url").alias("page_url")).dropDuplicates(["page_id"])
    records, found = contacts_with_fallback(first, second.join(where, "page_id").select(*columns))
    return records, found, pagers_of(parsed)


def card_contacts(cards: DataFrame, site: Column, least: int = 5) -> DataFrame:
    """Contacts (site, page_id, name, title, phone, email) of the cards of each site.

    The first page (by id) with ``least`` candidates sets the site's usual classes. Before it
    every candidate counts, from it on every element of a usual class. Equal contacts of a site
    are kept once, at their first place.
    """
    cards = cards.withColumn("site", site)
    rank = cards.filter("candidate").select("site", F.col("page_id").alias("page_ord"), "block_ord", "signature")
    usual = dominant_signatures(rank, least).select("site", "signature").withColumn("_usual", F.lit(True))
    enough = rank.groupBy("site", "page_ord").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    begin = enough.groupBy("site").agg(F.min("page_ord").alias("_begin")).join(usual.select("site").distinct(), "site", "left_semi")
    rows = cards.join(begin, "site", "left").join(usual, ["site", "signature"], "left")
    late = F.col("page_id") >= F.col("_begin")
    kept = rows.filter(F.coalesce((late & F.col("_usual").isNotNull()) | (~late & F.col("candidate")), F.col("candidate")))
    kept = kept.withColumn("_card", F.struct("page_id", "block_ord", "site", "link_email"))
    found = text_contact(kept.select(F.col("_card").alias("page_id"), "lines")).filter("title is not null")
    found = found.select("page_id.*", "name", "title", "phone", F.coalesce("email", X.blank_to_null("link_email")).alias("email"))
    same = [F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(f"_{c}") for c in ("name", "title", "phone", "email")]
    first = F.min(F.struct("page_id", "block_ord", "name", "title", "phone", "email")).alias("f")
    return found.groupBy("site", *same).agg(first).select("site", "f.page_id", "f.name", "f.title", "f.phone", "f.email")


def dominant_signatures(cards: DataFrame, least: int = 5, n: int = 2) -> DataFrame:
    """Per site the most common class signatures of the first page with enough blocks.

    ``cards`` (site, page_ord, block_ord, signature); blocks count with or without a class,
    signatures only with one. Equal counts keep the order of first appearance.
    """
    per_page = cards.groupBy("site", "page_ord").agg(F.count("*").alias("n"))
    first = per_page.filter(F.col("n") >= least).groupBy("site").agg(F.min("page_ord").alias("page_ord"))
    rows = cards.join(first, ["site", "page_ord"]).filter("signature <> ''")
    counts = rows.groupBy("site", "signature").agg(F.count("*").alias("blocks"), F.min("block_ord").alias("_first"))
    order = W.partitionBy("site").orderBy(F.desc("blocks"), "_first", "signature")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("_first")
