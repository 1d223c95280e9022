"""Operators 1, 2, 3, 4 and 10 against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
import zstandard

from lodestone.llm import arc_to_warc, html_tree, kneser_ney, secret_scan, tokens, zstd_langid

from . import fixtures

# ---- 1: HTML extraction

BODY = "".join(f"<p>{fixtures.prose(k, 40)}</p>" for k in range(4))
PAGE = f'<html><head><title> A &amp; B </title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">first link</a><li><a href="/b">second link</a></ul></nav><div class="ad">Buy, buy, buy, this is an advert, really.</div><div class="content"><h1>Head</h1>{BODY}</div><footer><p>Copyright, terms, privacy, contact, all rights reserved.</p></footer></body></html>'


def test_main_text_is_the_article():
    title, text, score, density = html_tree.extract(PAGE)
    assert title == "A & B" and score > 0 and density == 0
    assert text == "Head\n" + "\n".join(fixtures.prose(k, 40) for k in range(4))


class Plain(HTMLParser):
    """An independent tree of well-formed pages: nested lists ``[tag, words, parent, children]``."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["html", "", None, []]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag != "html":
            new = [tag, dict(attrs).get("class", ""), self.at, []]
            self.at[3].append(new)
            self.at = new

    def handle_endtag(self, tag):
        if tag != "html":
            self.at = self.at[2]

    def handle_data(self, data):
        self.at[3].append(data)


def brute_extract(page):
    """The method by definition, recursively and unhurried, of pages of div, section, p, a, span, nav, li, ul and td."""
    root = Plain(page).root
    blocks = {"div", "section", "p", "ul", "li", "td", "nav", "body", "html"}
    start = {"div": 5, "section": 3, "td": 3, "ul": -3, "li": -3, "nav": -25}

    def lines(n):
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        inner = "".join(map(lines, n[3]))
        return f"\n{inner}\n" if n[0] in blocks else inner

    def text(n):
        return "\n".join(x for x in (" ".join(y.split()) for y in lines(n).split("\n")) if x)

    def chars(n):
        return len("".join(n.split())) if isinstance(n, str) else sum(map(chars, n[3]))

    def linked(n):
        return 0 if isinstance(n, str) else chars(n) if n[0] == "a" else sum(map(linked, n[3]))

    def walk(n):
        yield n
        for c in n[3]:
            if not isinstance(c, str):
                yield from walk(c)

    nodes = list(walk(root))
    score = {}
    for n in nodes:
        if n[0] in ("p", "td", "div", "section") and not any(c[0] in blocks for c in n[3] if not isinstance(c, str)) and chars(n) >= 20 and len(text(n)) >= 25:
            up = n if n[0] in ("div", "section") else n[2]
            for share in (1, 2, 6, 9, 12):
                if up is not None:
                    score.setdefault(id(up), start.get(up[0], 0) + 25 * (up[1] == "content") - 25 * (up[1] == "sidebar"))
                    score[id(up)] += (1 + text(n).count(",") + min(len(text(n)) // 100, 3)) / share
                    up = up[2]
    density = lambda n: linked(n) / chars(n) if chars(n) else 0
    final = {id(n): score[id(n)] * (1 - density(n)) for n in nodes if id(n) in score}
    best = max((n for n in nodes if final.get(id(n), 0) > 0), key=lambda n: final[id(n)], default=None)
    if best is None:
        best = next((n for n in nodes if id(n) in final and final[id(n)] == max(final.values())), None)
    if best is None:
        return "\n".join(t for t in (text(root),) if t), 0.0
    top = final[id(best)]
    if best[2] is None:  # the whole page, but for its navigation
        for n in nodes:
            n[3] = [c for c in n[3] if isinstance(c, str) or c[0] != "nav"]
        return text(best), top
    out = []
    for n in best[2][3]:
        if n is best:
            out.append(text(n))
        elif not isinstance(n, str) and chars(n):
            bonus = 0.2 * top if n[1] and n[1] == best[1] else 0
            like = id(n) in score and final[id(n)] + bonus >= max(10, 0.2 * top)
            prose = n[0] == "p" and ((chars(n) > 80 and density(n) < 0.25) or (chars(n) <= 80 and density(n) == 0 and re.search(r"[.!?](\s|$)", text(n))))
            if like or prose:
                out.append(text(n))
    return "\n".join(x for x in out if x), top


def test_text_and_score_equal_brute_force():
    r = random.Random(2)
    kinds = Counter()
    for _ in range(400):
        def part(depth, cell=False):
            tag = r.choice(["div", "section", "p", "ul", "nav" if cell else "td", "nav"]) if depth < 3 else "p"
            words = r.choice(["", "", ' class="content"', ' class="sidebar"'])
            if tag == "p" or r.random() < 0.3:
                prose = fixtures.prose(r.randrange(99), r.randrange(1, 70))
                inner = r.choice([prose, f'<a href="x">{prose}</a>', f'{prose} <a href="x">more, here</a>', f"<span>{prose}</span>"])
            else:
                inner = "".join(part(depth + 1, cell or tag == "td") for _ in range(r.randrange(1, 5)))
            return f"<{tag}{words}>{inner}</{tag}>"

        page = "<html>" + "".join(part(0) for _ in range(r.randrange(1, 4))) + "</html>"
        want, top = brute_extract(page)
        _, text, score, _ = html_tree.extract(page)
        if top > 0:
            assert score == pytest.approx(top)
            assert text == want
        kinds[top > 0, "\n" in want] += 1
    assert all(kinds[True, x] > 20 for x in (True, False))


def test_pages_of_bare_containers():
    prose = "Some prose, with commas, and more of it to make a paragraph. " * 5
    page = f'<body><div class="menu"><a href=x>home</a></div><div>{prose}</div><div>{prose}</div><div>Sidebar junk</div>'
    assert html_tree.extract(page)[1] == "\n".join([prose.strip()] * 2)


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<", "<!", "<a '\"", "<!--", "<p", "&amp"])
def test_hostile_pages_take_linear_time(unit):
    began = time.process_time()
    html_tree.extract(unit * 60_000)
    assert time.process_time() - began < 5


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>short"), (4, "x", "<div>" * 3000 + "deep, deep, deep text of thirty letters" + "</div>" * 3000), (5, "y", "a < b <b> no end <p"), (6, "z", "<p>" + "long, " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "page_id long, url string, html string, text string, score double")
    got = html_tree.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[2] is None and by[3] == "" and by[None] == "short" and "deep text" in by[4] and len(by[6]) > 200_000
    assert html_tree.main_text(df.limit(0)).count() == 0


# ---- 2: language identification


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    syllables = {"aa": ["the", "ing", "and", "er", "wh"], "bb": ["que", "ción", "ado", "los", "ñi"], "cc": ["sch", "ung", "ein", "keit", "ü"]}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    train = [(lang, speech(lang, k, 300)) for lang in ("aa", "bb", "cc") for k in range(20)]
    dicts = zstd_langid.fit(spark.createDataFrame(train, "lang string, text string"), dict_bytes=16_384)
    assert sorted(dicts) == ["aa", "bb", "cc"] and all(0 < len(d) <= 16_384 for d in dicts.values())
    test = [(lang, speech(lang, 1000 + k, 5 + 20 * k)) for lang in dicts for k in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(test)], "doc_id long, text string, margin string")
    got = {r.doc_id: r.lang_pred for r in zstd_langid.identify(df, dicts).collect()}
    right = sum(got[i] == lang for i, (lang, _) in enumerate(test))
    assert right >= 0.98 * len(test) and not any(got[i] not in (None, lang) for i, (lang, _) in enumerate(test))


def test_short_rows_and_long_ones_fill_the_dictionaries(spark):
    """A language of 300 short rows has a dictionary; one of a single long row fills it from all of its text."""
    rows = [("aa", f"word{k} in a row") for k in range(300)] + [("bb", "".join(f"{k:05d} " for k in range(20_000)))]
    dicts = zstd_langid.fit(spark.createDataFrame(rows, "lang string, text string"), dict_bytes=8_192)
    assert dicts["aa"].count(b"\n") == 300 and len(dicts["bb"]) == 8_192
    at = [int(x[2:7]) for x in dicts["bb"].decode().split("\n") if x[2:7].isdigit()]
    assert max(at) > 10_000 and zstd_langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(5), dict_bytes=8_192) == dicts


def brute_choice(text, dicts, margin=zstd_langid.MARGIN):
    """Language, smallest and margin from plain compressors of each chunk."""
    data = (text or "").encode()
    if len(data) < 8 or not dicts:
        return None, None, None
    total = {}
    for lang, d in dicts.items():
        params = zstandard.ZstdCompressionParameters.from_level(3, source_size=1024, dict_size=len(d), write_content_size=False, write_dict_id=False, write_checksum=False)
        press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        total[lang] = 0
        for at in range(0, len(data), 1024):
            total[lang] += len(press.compress(data[at : at + 1024]))
    least = min(sorted(total), key=total.get)
    if len(total) == 1:
        return least, least, None
    second = min(v for k, v in total.items() if k != least)
    gap = (second - total[least]) / second
    return (least if gap >= margin and gap > 0 else None), least, gap


def test_choices_equal_brute_force(spark):
    """Margins, and ties: two languages of equal dictionaries are never told apart."""
    dicts = {lang: speech(lang, 1, 300).encode() for lang in ("aa", "bb", "cc")} | {"dd": speech("cc", 1, 300).encode()}
    texts = [None, "", "short", *(speech(lang, k, n) for lang in ("aa", "bb", "cc") for k, n in enumerate((1, 3, 20, 400))), speech("aa", 9, 30) + " " + speech("bb", 9, 30)]
    got = {r.doc_id: (r.lang_pred, r.smallest, r.margin) for r in zstd_langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dicts).collect()}
    for i, t in enumerate(texts):
        pred, least, gap = brute_choice(t, dicts)
        assert got[i][:2] == (pred, least) and got[i][2] == (pytest.approx(gap) if gap is not None else None)
    assert got[14][1] == "cc" and got[14][0] is None and got[14][2] == 0


def test_language_of_odd_rows(spark):
    dicts = {"aa": speech("aa", 1, 500).encode(), "bb": speech("bb", 1, 500).encode()}
    rows = [(1, None), (2, ""), (3, "ab"), (4, "0123456789 0123456789"), (None, speech("bb", 7, 40)), (5, speech("aa", 8, 30_000)), (5, speech("aa", 8, 30_000))]
    got = zstd_langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), dicts).collect()
    assert [r.lang_pred for r in got] == [None, None, None, None, "bb", "aa", "aa"]
    assert all(r.lang_pred is None for r in zstd_langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect())
    langs, presses = zstd_langid.compressors(dicts)
    text = speech("aa", 3, 700).encode()
    assert zstd_langid.sizes(text, presses, 500) == [sum(len(p.compress(text[a : a + 500])) for a in range(0, len(text), 500)) for p in presses]
    empty = spark.createDataFrame([], fixtures.SCHEMA)
    assert zstd_langid.fit(empty) == {} and zstd_langid.identify(empty, dicts).count() == 0


# ---- 3: perplexity

SYMBOLS = re.compile(tokens.SYMBOL_RE)


def brute_discounts(counts):
    n = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [0] + [min(hi, max(0.05, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y)) for k, hi in ((1, 0.95), (2, 1.95), (3, 2.95))]


def brute_perplexities(rows, trusted):
    """The interpolated formula, word by word: (c - D) / c(v) + gamma(v) * ((N - D') / N. + gamma' / V)."""
    toks = [SYMBOLS.findall((t or "").lower()) for _, t, _ in rows]
    c = Counter(p for (i, _, _), ws in zip(rows, toks) if i in trusted for p in zip(["<s>", *ws[:-1]], ws))
    before = Counter(w for _, w in c)
    d, e = brute_discounts(c.values()), brute_discounts(before.values())
    followers = {}
    for (v, _), k in c.items():
        followers.setdefault(v, []).append(k)
    all_, kinds = sum(before.values()), len(before)
    rest = sum(e[min(k, 3)] for k in before.values()) / all_ / (kinds + 1)
    out = []
    for ws in toks:
        logp = 0.0
        for v, w in zip(["<s>", *ws[:-1]], ws):
            low = (before[w] - e[min(before[w], 3)]) / all_ + rest
            own = followers.get(v)
            seen = (c[v, w] - d[min(c[v, w], 3)]) / sum(own) if own else 0.0
            logp += math.log(seen + (sum(d[min(k, 3)] for k in own) / sum(own) if own else 1.0) * low)
        out.append(math.exp(-logp / len(ws)) if ws else None)
    return out


def test_probabilities_sum_to_one():
    """The brute-force formula is a distribution over the tokens of trusted text and an unknown one."""
    rows = [(k, fixtures.prose(300 + k, 50), "en") for k in range(5)]
    words = sorted({w for _, t, _ in rows for w in SYMBOLS.findall(t.lower())}) + ["unheardof"]
    for context in ("river", "nowhere"):
        one = brute_perplexities([*rows, (9, context, "en"), *((10 + k, f"{context} {w}", "en") for k, w in enumerate(words))], set(range(5)))
        assert sum(one[5] / p**2 for p in one[6:]) == pytest.approx(1)


def perplexity_rows():
    return [(r[0], r[1], r[2]) for r in fixtures.rows()] + [(100 + k, fixtures.prose(300 + k, 50 + k), "en") for k in range(12)] + [(120, fixtures.prose(500, 30), "a\0b"), (121, "今天天气很好！ 我们 " + fixtures.prose(501, 9), "zh")]


@pytest.mark.parametrize("passes", [1, 3])
def test_perplexities_equal_brute_force(spark, passes):
    rows = perplexity_rows()
    labels = [(i, 1, 0) for i in (0, 3, 4, 7, 10, 100, 101, 102, 103)] + [(1, 0, 0), (8, 1, 1), (104, None, None), (None, 1, 0), (0, 1, 0), (105, 1, None)]
    trusted = {0, 3, 4, 7, 10, 100, 101, 102, 103, 105}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, n_tokens int, uid int")
    got = kneser_ney.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), passes=passes, quantile=0.9).collect()
    want = brute_perplexities(rows, trusted)
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), str(x[1]), x[2] or 0.0)
    for (i, lang, p), (j, tongue, q) in zip(sorted(((r.doc_id, r.lang, r.perplexity) for r in got), key=key), sorted(((i, x, p) for (i, _, x), p in zip(rows, want)), key=key)):
        assert (i, lang, p) == (j, tongue, pytest.approx(q, rel=1e-4) if q else None)
    for lang in ("en", None):
        unseen = sorted(p for (i, _, x), p in zip(rows, want) if i not in trusted and x == lang and p)
        limit = next(r.threshold for r in got if r.lang == lang)
        assert limit == pytest.approx(unseen[math.ceil(0.9 * len(unseen)) - 1], rel=1e-4)
    assert all(r.keep == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)


def test_every_trusted_token_has_its_own_counts(spark):
    """More types than any fixed vocabulary took; a text of unseen words must look worse than every trusted one."""
    words = [f"w{k}x" for k in range(70_000)]
    rows = [(i, " ".join(words[i * 1000 : i * 1000 + 1000]), "en") for i in range(70)] + [(90, " ".join(f"u{k}" for k in range(500)), "en"), (91, fixtures.prose(9, 60), "en")]
    labels = [(i, 1, 0) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in kneser_ney.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute_perplexities(rows, set(range(70)))
    assert all(got[i] == pytest.approx(p, rel=1e-4) for (i, _, _), p in zip(rows, want))
    assert got[90] > max(got[i] for i in range(70))


def test_kept_by_label(spark):
    """Of the test table's labelled documents at least nine in ten good ones stay and at most one in ten bad ones."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = kneser_ney.quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").select("quality", "keep").collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_bad_documents_are_rejected_whatever_their_share(spark):
    """Half of the unlabelled documents are word salad: all of it goes, and the good half stays."""
    r = random.Random(4)
    rows = [(i, fixtures.prose(i, 120), "en") for i in range(500)] + [(i, " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(120)), "en") for i in range(500, 600)]
    labels = [(i, 1, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.keep for x in kneser_ney.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not any(got[i] for i in range(500, 600))
    assert sum(got[i] for i in range(400, 500)) >= 90 and sum(got[i] for i in range(400)) >= 395


def test_quality_without_trusted_text(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(fixtures.docs(spark), none).collect()
    assert len(got) == len(fixtures.rows()) and not any(r.keep or r.perplexity for r in got)
    every = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = kneser_ney.quality(fixtures.docs(spark).filter("doc_id is not null"), every).collect()
    assert all(r.keep == (r.n_tokens > 0) for r in seen)
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert kneser_ney.quality(fixtures.empty(spark), some).count() == 0


# ---- 4: ARC to WARC


def test_archives_of_both_versions_round_trip():
    items = [("http://a.b/c d", "<p>x\n\nfiledesc:// no header 1\n</p>", "19970203040506"), ("http://a.b/", "", "20010101000000"), ("http://é/", "é" * 5000, "20020202020202")]
    for version in (1, 2):
        got = list(arc_to_warc.records(arc_to_warc.arc_file("f.arc", version, items), "f"))
        assert [r["warc_type"] for r in got] == ["warcinfo"] + ["response"] * 3 and all(r["arc_version"] == version and r["fault"] is None for r in got)
        for r, (url, page, date) in zip(got[1:], items):
            assert r["target_uri"] == url.replace(" ", "%20") and r["block"].endswith(page.encode()) and r["status"] == 200
            assert r["warc_date"].translate({ord(c): None for c in "-T:Z"}) == date
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
            head, block = arc_to_warc.serialise(r).split(b"\r\n\r\n", 1)
            assert f"Content-Length: {len(r['block'])}".encode() in head and block == r["block"] + b"\r\n\r\n"
        assert len({r["record_id"] for r in got}) == 4


def by_hand(version, records):
    """An archive written out by hand: ``(header line, body)``, with the version block first."""
    names = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = b"%d 0 hand\n%s\n" % (version, names)
    return b"filedesc://hand.arc 0.0.0.0 19980102030405 text/plain %d\n%s\n" % (len(block), block) + b"".join(h + b"\n" + b + b"\n" for h, b in records)


def test_archives_written_by_hand():
    answer = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\ngone\n\n"
    one = by_hand(1, [(b"http://a.org/x y 10.1.2.3 19990203040506 text/html %d" % len(answer), answer), (b"dns:a.org 10.1.2.4 19990203040507 text/dns 7", b"1.2.3.4"), (b"http://a.org/z 10.1.2.3 19990101 - 0", b"")])
    info, page, dns, bare = arc_to_warc.records(one, "hand.arc")
    assert info["warc_type"] == "warcinfo" and b"arcVersion: 1\r\n" in info["block"] and b"arcFields: URL IP-address" in info["block"] and info["content_type"] == "application/warc-fields"
    assert (page["warc_type"], page["status"], page["warc_date"], page["ip_address"], page["target_uri"], page["block"]) == ("response", 404, "1999-02-03T04:05:06Z", "10.1.2.3", "http://a.org/x y", answer)
    assert page["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"gone\n\n").digest()).decode() and page["content_type"] == "application/http; msgtype=response"
    assert (dns["warc_type"], dns["content_type"], dns["block"], dns["fault"]) == ("resource", "text/dns", b"1.2.3.4", None)
    two = by_hand(2, [(b"http://b.org/ 10.1.2.3 19990203040506 text/html 200 abc - 1234 hand.arc %d" % len(answer), answer)])
    assert [r["arc_version"] for r in arc_to_warc.records(two)] == [2, 2]


def test_archives_of_pages_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}") for i in range(450)] + [(None, f"http://b/{i}", None) for i in range(9)] + [(7, "http://a/7", "<p>again")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    ways = [sorted(r.record_id for r in arc_to_warc.convert(arc_to_warc.pages_to_arc(df.repartition(n))).collect()) for n in (1, 5)]
    assert ways[0] == ways[1] and len(set(ways[0])) == len(ways[0])
    got = arc_to_warc.convert(arc_to_warc.pages_to_arc(df)).filter("warc_type <> 'warcinfo'")
    assert got.count() == len(rows) and got.filter("fault is not null").count() == 0


def test_odd_archives():
    page = b"HTTP/1.0 200 OK\r\n\r\nx"
    line = b"http://a/ 1.1.1.1 19990203040506 text/html %d" % len(page)
    # names without a length: those of the version hold
    block = b"1 0 hand\nURL IP-address Archive-date Content-type Something\n"
    data = b"filedesc://f 0.0.0.0 19980102030405 text/plain %d\n%s\n%s\n%s\n" % (len(block), block, line, page)
    assert [(r["warc_type"], r["fault"]) for r in arc_to_warc.records(data)] == [("warcinfo", "names"), ("response", None)]
    # an impossible date: that of the archive, or 1970
    for head, date in ((by_hand(1, []), "1998-01-02T03:04:05Z"), (b"", "1970-01-01T00:00:00Z")):
        *_, r = arc_to_warc.records(head + b"http://a/ 1.1.1.1 19991399040506 text/html %d\n%s\n" % (len(page), page))
        assert (r["fault"], r["warc_date"]) == ("date", date) and f"WARC-Date: {date}".encode() in arc_to_warc.serialise(r)
    # a superscript digit is no length
    assert [r["fault"] for r in arc_to_warc.records("http://a/ 1.1.1.1 19990203040506 text/html \u00b2\nx\n".encode() + line + b"\n" + page + b"\n")] == ["header"]
    # gzip members, one of them damaged, and many of them in linear time
    members = [gzip.compress(line + b"\n" + page + b"\n", mtime=0) for _ in range(3)]
    assert len(list(arc_to_warc.records(b"".join(members)))) == 3
    damaged = members[0] + members[1][:15] + b"\xff" * 9 + members[1][24:] + members[2]
    assert [r["block"] for r in arc_to_warc.records(damaged)][0] == page and "gzip" in [r["fault"] for r in arc_to_warc.records(damaged)]
    assert list(arc_to_warc.records(b"\x1f\x8b\x08 rubbish")) == []
    began = time.process_time()
    assert sum(1 for _ in arc_to_warc.records(members[0] * 20_000)) == 20_000 and time.process_time() - began < 20


def test_damaged_archives():
    good = arc_to_warc.arc_file("f", 1, [("http://a/", "x", "19970203040506"), ("http://b/", "y", "99999999999999")])
    assert [r["fault"] for r in arc_to_warc.records(good)] == [None, None, "date"]
    assert list(arc_to_warc.records(good[:-20]))[-1]["fault"] == "short"
    broken = good.replace(b"text/html 46\n", b"text/html 40\n", 1)
    assert len([r for r in arc_to_warc.records(broken) if r["target_uri"] == "http://b/"]) == 1
    assert list(arc_to_warc.records(b"")) == [] and list(arc_to_warc.records(b"no archive\nat all")) == []
    import gzip

    assert len(list(arc_to_warc.records(gzip.compress(good[:100]) + gzip.compress(good[100:])))) == 3


def test_urls_without_a_scheme_and_lengths_too_long():
    items = [(u, f"<p>{u}</p>", "19970203040506") for u in ("www.example.com/x", "/a/b?c=1 2", "x", "-", "http://a/")]
    for version in (1, 2):
        good = arc_to_warc.arc_file("f", version, items)
        got = list(arc_to_warc.records(good))[1:]
        assert [r["target_uri"] for r in got] == ["www.example.com/x", "/a/b?c=1%202", "x", "-", "http://a/"] and not any(r["fault"] for r in got)
        assert all(r["warc_type"] == "response" and r["status"] == 200 for r in got)
        size = len(got[1]["block"])
        for wrong in (size + 100, size + 250, 10**6):
            broken = good.replace(b" %d\nHTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>/a" % size, b" %d\nHTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>/a" % wrong)
            assert broken != good
            again = list(arc_to_warc.records(broken))[1:]
            assert [r["target_uri"] for r in again] == [r["target_uri"] for r in got]
            assert [r["block"] for r in again] == [r["block"] for r in got] and [r["fault"] for r in again] == [None, "length", None, None, None]


def test_pages_become_records(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(450)] + [(None, None, None), (3, "http://h/3", "<p>3</p>"), (7, "http://h/long", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string").coalesce(1)
    got = arc_to_warc.convert(arc_to_warc.pages_to_arc(df)).collect()
    pages = [r for r in got if r.warc_type == "response"]
    assert len(pages) == len(rows) and len(got) - len(pages) == len({r.archive for r in got}) and {r.arc_version for r in got} <= {1, 2}
    assert sorted(r.payload_digest for r in pages) == sorted("sha1:" + base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode() for r in rows)
    assert arc_to_warc.convert(arc_to_warc.pages_to_arc(df.limit(0))).count() == 0


# ---- 10: secrets


@pytest.mark.parametrize(
    "text, names",
    [
        ('token = "24be6a0f91c3d7e58b42"', ["token"]), ("x password=b7db7aa4a5fcc78305 y", ["password"]), ("db:\n  password: 'hU7$kq9!zLw2'", ["password"]), ('{"apiKey": "AKq83hs7Ndk2LwPz91"}', ["apiKey"]),
        ('const clientSecret: string = "p9Zk2mQw8RtY4";', ["clientSecret"]), ('A = "q8Zr7"\nB = "Lw2Pk9"\nsecret_key = A + B', ["secret_key"]), ('BASE=zX81kq\nexport API_TOKEN="${BASE}77Lpw29"', ["API_TOKEN"]),
        ('<password>k2J9xQ71mm</password>', ["password"]), ('cfg["auth_token"] = "9f8e7d6c5b4a39281706"', ["auth_token"]), ("pwd := `Zx9_Kq82_Lm`", ["pwd"]), ('password = os.environ["PASSWORD"]', []), ('password = "changeme"', []), ('password: "your_password_here"', []),
        ('if password == "Zk29xLq81mP":', []), ('title = "b7db7aa4a5fcc78305"', []), ("the password: was lost", []), ('secret = "aaaaaaaaaaaa"', []), ("http://example.com/a", []), ('token = "open and never closed', []), ("", []),
    ],
)
def test_secrets(text, names):
    assert [f[2] for f in secret_scan.scan(text)] == names


def test_propagated_value_and_places():
    text = 'first = "ab12"\nsecond = first + "CD34ef"\npassword = second + "gh56"'
    ((start, end, name, value, score),) = secret_scan.scan(text)
    assert value == "ab12CD34efgh56" and text[start:end] == 'second + "gh56"' and score >= 1


def test_random_keys_are_no_paths_or_placeholders():
    r = random.Random(6)
    keys = [base64.b64encode(r.randbytes(30)).decode() for _ in range(3000)]
    assert sum("/" in k and not set("+=") & set(k) for k in keys) > 500
    heads = ("foo", "bar", "env", "test", "none", "string")
    keys += [h + f"{r.getrandbits(40):010x}Q7" + base64.b32encode(r.randbytes(5)).decode() for h in heads for _ in range(20)]
    missed = [k for k in keys if not secret_scan.scan(f'aws_secret_access_key = "{k}"')]
    assert len(missed) <= 2, missed
    for dull in ("/etc/ssl/private/server.key", "./config/secrets.yaml", "src/main/TokenStore.java", "/usr/lib/python3.12/site-packages", "changeme123", "testpassword", "foobar", "your-api-key-here"):
        assert not secret_scan.scan(f'secret_key = "{dull}"'), dull


def test_long_secrets_are_found_whole():
    r = random.Random(7)
    blob = base64.b64encode(r.randbytes(9000)).decode()
    assert [f[3] for f in secret_scan.scan(f'private_key = "{blob}"')] == [blob]
    assert [f[3] for f in secret_scan.scan(f'{{"a": 1, "privateKey": "{blob}", "b": 2}}')] == [blob]
    assert [f[3] for f in secret_scan.scan(f"<password>{blob}</password>")] == [blob]
    assert [f[3] for f in secret_scan.scan(f'part = "{blob}"\nclient_secret = part + "Zx9"')] == [blob + "Zx9"]
    assert secret_scan.scan('x = "ab12CD34"\n' + "x = x + x\n" * 200) == []
    assert len(secret_scan.scan('{"token": "open, ' * 20_000)) == len(secret_scan.scan("{'token': 'open, " * 20_000))


def test_planted_secrets_in_prose(spark):
    r = random.Random(8)
    rows, planted = [], set()
    for i in range(60):
        text = fixtures.prose(400 + i, 200)
        if i % 3 == 0:
            text = text[:300] + f" password={r.getrandbits(72):018x} " + text[300:]
            planted.add(i)
        rows.append((i, text, "x", 1))
    rows += [(None, 'token = "24be6a0f91c3d7e58b42"', "x", 1), (70, None, "x", 1), (71, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, start int")
    assert {x.doc_id for x in secret_scan.secrets(df).collect()} == planted | {None}
    assert secret_scan.secrets(df.limit(0)).count() == 0


def test_names_and_types_of_any_length():
    value = "aB3$kL9pQz7!xY2m"
    for text, name in (("password" + " " * 5000 + f'= "{value}"', "password"), ("long " * 900 + f'x\n"{"deep " * 300}password": "{value}"', "deep " * 300 + "password"), (f'let api_key: Option<{"Very" * 2000}> = "{value}"', "api_key"), ("a." * 3000 + f'token = "{value}"', "a." * 3000 + "token")):
        assert [x[3] for x in secret_scan.scan(text) if x[2] == name] == [value]
    long = "aB3$kL9pQz7!xY2m" * 1000
    assert [x[3] for x in secret_scan.scan(f'password = "{long}"')] == [long]
    for hostile in ("a " * 60_000 + "=", "= " * 60_000, "a: b c " * 20_000, '"a b ' * 20_000 + '":', " " * 100_000 + "=", ": a" * 30_000 + " = 3"):
        began = time.process_time()
        secret_scan.scan(hostile)
        assert time.process_time() - began < 5


def simple_assignments(text):
    """A second, simpler lexer: ``name = "literal"`` and ``name: "literal"`` by one expression for each line."""
    out = []
    for line in text.split("\n"):
        for m in re.finditer(r"([A-Za-z_][A-Za-z_0-9.]*)\s*[=:]\s*\"([^\"\\]*)\"", line):
            out.append((m[1], m[2]))
    return out


def test_findings_equal_a_second_lexer():
    r = random.Random(8)
    names = ["password", "api_key", "db.secret", "colour", "title", "auth_token", "x", "userName"]
    for _ in range(200):
        lines = []
        for _ in range(r.randrange(1, 9)):
            value = "".join(r.choice("abcXYZ0189-$%/+ ") for _ in range(r.randrange(0, 40)))
            lines.append(r.choice(["", "  ", "export ", "const "]) + r.choice(names) + r.choice([" = ", "=", ": "]) + f'"{value}"' + r.choice(["", ";", ","]))
        text = "\n".join(lines)
        want = [(n, v) for n, v in simple_assignments(text) if secret_scan.name_weight(n) > 0 and secret_scan.name_weight(n) + secret_scan.literal_score(v) >= secret_scan.THRESHOLD]
        assert [(x[2], x[3]) for x in secret_scan.scan(text)] == want


def test_secrets_of_repeated_and_odd_rows(spark):
    rows = [(1, 'password = "aB3$kL9pQz7!xY2m"')] * 2 + [(2, None), (3, ""), (None, 'x\npassword = "aB3$kL9pQz7!xY2m"'), (4, "word " * 100_000 + 'password = "aB3$kL9pQz7!xY2m"')]
    got = secret_scan.secrets(spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, start int, name int")).collect()
    assert sorted((str(r.doc_id), r.start) for r in got) == [("1", 11), ("1", 11), ("4", 500_011), ("None", 13)]
