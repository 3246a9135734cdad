"""URL filter and token counts against plain computations."""

import random
import re

import duckdb
import public_tokenizers
import pytest

from spokeframe.llm import tokencount, urlfilter

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme/porn": ("", "", None, "block"),
    "http://A.COM/en/x?y": ("a.com", "/en/x", "com/en/", "block"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"),
    "http://telecom/en/": ("telecom", "/en/", None, "allow"),
    "http://q.example.com/en/77/porn": ("q.example.com", "/en/77/porn", "example.com/en/7", "allow"),
    "http://q.example.net/de/8#a": ("q.example.net", "/de/8", "example.net/de/8", "block"),
    "http://q.example.org/EN/1": ("q.example.org", "/EN/1", None, "allow"),
    "http://popcorn.org/xxxl": ("popcorn.org", "/xxxl", None, "allow"),
    "http://x.org/?q=XXX": ("x.org", "/", None, "block"),
    "http://x.org/bet/bet-bet": ("x.org", "/bet/bet-bet", None, "allow"),
    "http://x.org/bet-win": ("x.org", "/bet-win", None, "block"),
    "http://x.org/free-win": ("x.org", "/free-win", None, "allow"),
    "http://x.org/free-win/deal": ("x.org", "/free-win/deal", None, "block"),
    "http://bet.bonus.org?free": ("bet.bonus.org", "", None, "block"),
    "http://cheap-pills.org": ("cheap-pills.org", "", None, "block"),
    "http://cheap_pills.org": ("cheap_pills.org", "", None, "block"),
    "http://x.org/" + "a/" * 50_000 + "porn": ("x.org", "/" + "a/" * 50_000 + "porn", None, "block"),
    "http://éxxx.org/ÄÖ": ("éxxx.org", "/ÄÖ", None, "block"),
    "a://b://c/xxx": ("b:", "//c/xxx", None, "block"),
}


def test_urls(spark):
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(URLS)] + [(None, "http://x.org", "h", "p", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    got = urlfilter.judge_urls(pages).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None] == list(URLS.values())
    assert len(got) == len(rows) and urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_automaton_finds_what_patterns_find():
    terms = urlfilter.automaton()
    for url in list(URLS) + ["x.xxx.bet+bet/win.porn/porno?warez-malware", "xxx/xxx_xxx", "spam-farm"]:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
        hit = lambda t: len(re.findall(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text))
        assert urlfilter.weigh(url or "", terms) == (sum(map(hit, urlfilter.STRICT)), sum(w * bool(hit(t)) for t, w in urlfilter.SOFT.items()))


def test_vocabulary_from_a_table(spark):
    rows = [("Alpha", 2, 0), ("alpha", 1, 0), ("beta", 1, 0), ("gamma", None, 0), ("gamma", 5, 0), (None, 1, 0), ("", 3, 0), ("delta", 0, 0)]
    terms = spark.createDataFrame(rows, "term string, weight int, of int")
    strict, soft = urlfilter.vocabulary(terms)
    assert strict == ("gamma",) and soft == {"alpha": 2, "beta": 1}
    urls = ["http://a.b/alpha", "http://a.b/alpha/beta", "http://a.b/beta/beta/beta", "http://a.b/GAMMA", "http://a.b/gammas"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = lambda *v: [r.verdict for r in urlfilter.judge_urls(pages, *v).orderBy("page_id").collect()]
    assert verdicts(strict, soft) == ["allow", "block", "allow", "block", "allow"]
    assert verdicts(*urlfilter.vocabulary(terms.limit(0))) == ["allow"] * 5
    with pytest.raises(ValueError):
        urlfilter.vocabulary(terms, most=2)


def test_counts(spark, odd_docs, no_docs):
    assert tokencount.count_tokens(no_docs, PATH, PATTERN).count() == 0
    encode, sizes = tokencount.encoding(PATH, PATTERN)
    extra = spark.createDataFrame([(100, "\n\na\n\n  b c\n\n\n", "", "", 0, "", 0, ""), (101, "\n\n", "", "", 0, "", 0, ""), (102, "é\n 漢字🙂\n\t\tx = 1\n", "", "", 0, "", 0, "")], odd_docs.schema)
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(extra)
    got = {}
    for r in tokencount.count_tokens(docs, PATH, PATTERN).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.first_byte, r.n_bytes, r.n_tokens, r.n_crossing, r.doc_tokens))
    for r in docs.collect():
        data = (r.text or "").encode()
        cuts = [0, *(m.end() for m in re.finditer(rb"\n\s*", data) if m.end() < len(data)), len(data)]
        ids = encode.encode_ordinary(r.text or "")
        own, cross, at = [0] * (len(cuts) - 1), [0] * (len(cuts) - 1), 0
        for t in ids:
            end = at + int(sizes[t])
            held = [sum(a <= i < b for i in range(at, end)) for a, b in zip(cuts, cuts[1:])] if end - at < 50 else None
            section = held.index(max(held)) if held else 0
            own[section] += 1
            cross[section] += bool(held) and max(held) < end - at
            at = end
        want = [(i, a, b - a, own[i], cross[i], len(ids)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(got[r.doc_id]) == want and sum(own) == len(ids)


def test_counts_of_repeated_rows_and_rows_without_an_id(spark, odd_docs):
    """Each row counts for itself: repeated rows come as often, and a null id stays null."""
    from collections import Counter

    given = odd_docs.collect()
    got = tokencount.count_tokens(odd_docs, PATH, PATTERN).collect()
    assert Counter(r.doc_id for r in got if r.section == 0) == Counter(r.doc_id for r in given)
    encode, _ = tokencount.encoding(PATH, PATTERN)
    want = Counter((r.doc_id, len(encode.encode_ordinary(r.text or ""))) for r in given)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.section == 0) == want
    assert sum(r.n_tokens for r in got) == sum(len(encode.encode_ordinary(r.text or "")) for r in given)


def test_rules_are_those_of_trying_each():
    """Also rules that tie in length, two of one host and path, and hosts and paths that are empty."""
    rnd = random.Random(7)
    hosts, paths = ["com", "a.com", "b.a.com", "aa.com", "net", "b.net", "", "com."], ["", "/", "/en/", "/en/7", "/de/", "/fr/"]
    for _ in range(300):
        rules = tuple((rnd.choice(["allow", "block"]), rnd.choice(hosts), rnd.choice(paths)) for _ in range(rnd.randrange(12)))
        held = urlfilter.rules_by_host(rules)
        for host in [*hosts, "x.b.a.com", "xa.com", "x.com.", "org"]:
            for path in [*paths, "/en/70", "/e"]:
                fits = [(len(h + p), h + p, action) for action, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
                assert urlfilter.find_rule(host, path, held) == ((max(fits)[2], max(fits)[1]) if fits else None)


def test_rules_are_those_of_the_contract(spark):
    """The contract's words are written out here, as the code and the SQL take theirs from one list."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: action for action, host, path in urlfilter.RULES} == contract and len(urlfilter.RULES) == len(contract)
    urls = {
        "http://com/en/": "com/en/",
        "http://www.example.com/en/8": "com/en/",
        "http://example.com/en/": "com/en/",
        "http://EXAMPLE.com/en/7": "example.com/en/7",
        "http://a.b.example.com/en/70/casino?x": "example.com/en/7",
        "http://net/de/": "net/de/",
        "http://www.example.net/de/7#a": "net/de/",
        "http://EXAMPLE.NET/de/porn?xxx": "net/de/",
        "http://casino.net/de/": "net/de/",
        "http://example.net/de/8": "example.net/de/8",
        "http://a.b.example.net/de/80/": "example.net/de/8",
        "http://badexample.net/de/8": "net/de/",
        "http://example.org/es/1": "org/es/",
        "http://org/es/": "org/es/",
        "http://example.net/de?/de/8": None,
        "http://example.net:80/de/8": None,
        "http://example.org/de/8": None,
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    want = {i: (rule, contract.get(rule, "allow")) for i, rule in enumerate(urls.values())}
    assert got == want
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert {i: (rule, verdict) for i, rule, verdict in con.sql(f"SELECT page_id, rule, verdict FROM ({urlfilter.ORACLE_SQL})").fetchall()} == want
