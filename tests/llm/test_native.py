"""Language ID, line dedup and the URL filter, on odd rows and against plain Python."""

import hashlib
import random
import zlib

from tremorscope.llm import compression_lang as cl
from tremorscope.llm import line_dedup as ld
from tremorscope.llm import source_mixing as sm
from tremorscope.llm import url_reputation as ur

LANGS = {"aa": ["tion", "the ", "ing ", "and ", "er", "of "], "bb": ["sch", "ung ", "der ", "keit ", "ein", "ich "], "cc": ["eau", "oux ", "les ", "que ", "aire", "ois "]}


def line_oracle(docs):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(strip).translate(low), set()).add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(strip).translate(low)) >= 10 and len(held[k]) >= 2 and d != min(held[k]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["a common line of text", "  A COMMON line of text\t", "short", "", "Éa common line of text", "x" * 9, "y" * 10, "Y" * 10 + "\r"]
    docs = [(i, "\n".join(rng.choice(pool + [f"own line {i} {j}"]) for j in range(rng.randint(1, 8)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "\n"), (203, "z" * 50000 + "\n" + "z" * 50000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'q' as d", "2 as h1").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in ld.drop_repeated_lines(frame).collect()}
    assert got == line_oracle(docs)
    for r in ld.digest(frame).collect():
        assert r.kept_sha256 == hashlib.sha256(got[r.doc_id][2].encode()).hexdigest()
    assert ld.digest(frame.limit(0)).count() == 0
    three = ld.drop_repeated_lines(spark.createDataFrame([(i, "one line of text") for i in (1, 2)], "doc_id long, text string"), min_docs=3)
    assert sum(r.n_dropped for r in three.collect()) == 0
    odd = ld.drop_repeated_lines(spark.createDataFrame([(None, "a line of some text"), (5, "a line of some text"), (5, "a line of some text")], "doc_id long, text string"))
    assert sum(r.n_dropped for r in odd.collect()) == 0


def test_language_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, "".join(rng.choice(LANGS[lang]) for _ in range(rng.choice((20, 200)))), lang))
    rows += [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None), (903, "the ing and " * 9000, None), (None, "der ung sch keit ", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as source", "2 as n_chars")
    got = {r.doc_id: r for r in cl.digest(docs).collect()}
    assert len(got) == len(rows)
    held = [x for x in rows[:400] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all(got[x[0]].held_out for x in held) and not any(got[x[0]].held_out for x in rows[:400] if x not in held)
    assert sum(got[x[0]].lang_pred == x[2] for x in held) > 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = cl.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    empty = cl.digest(docs.limit(0))
    assert empty.count() == 0 and {r.lang_pred for r in cl.digest(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}


def test_urls(spark):
    urls = ["http://A.B.example.com/en/7?x", "https://example.com/en/8", "ftp://x.net/de/1", "http://example.net/de/8", "http://notexample.net/de/8", "http://m.org/es/#a", "http://m.org", "no scheme", None, "HTTP://Ü.com/EN/1", "http://example.net?de/8", "://h.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "1 as n", "2 as bad", "3 as rate", "4 as bound", "5 as fit", "6 as p_")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ur.judge_pages(pages, none).collect()}
    assert got[0] == ("a.b.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[3] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[4] == ("notexample.net", "/de/8", "net/de/", "allow")
    assert got[5] == ("m.org", "/es/", "org/es/", "block")
    assert got[6] == ("m.org", "", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("Ü.com", "/EN/1", None, "allow") and got[10] == ("example.net", "", None, "allow") and got[11] == ("h.com", "/en/", "com/en/", "block")
    assert ur.judge_pages(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.site.com", 1)] * 60 + [("good.site.com", 0)] * 60 + [("new.spam.net", 1)] * 2 + [("old.spam.net", 1)] * 90 + [("lone.fine.org", 1)] + [(f"h{i}.fine.org", 0) for i in range(90)] + [(None, 1), ("x.org", None)]
    got = {r.host: r for r in ur.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.site.com"].bound > 0.5 > got["good.site.com"].rate
    assert got["new.spam.net"].rate > got["lone.fine.org"].rate  # its domain lends it its own record
    assert got["lone.fine.org"].bound < 0.25 and all(0 <= r.rate <= 1 and r.bound <= r.rate for r in got.values())
    assert got["x.org"].n == 0 and got["x.org"].rate < 0.1  # its suffix is nearly clean


def reputation_oracle(rows, z):
    """{host: (rate, bound)} in plain Python; every host has two labels or more and a suffix of one."""
    hosts = {}
    for host, bad in rows:
        n, b = hosts.setdefault(host, [0, 0])
        hosts[host] = [n + (bad is not None), b + (bad or 0)]

    def strength(units):
        units = [(n, b, m) for n, b, m in units if n]
        excess = max(sum(n * (b / n - m) ** 2 for n, b, m in units) - sum(m * (1 - m) for _, _, m in units), 0)
        s = sum((n - 1) * m * (1 - m) for n, _, m in units) / excess - 1 if excess > 0 else 1000
        return min(max(s, 1), 1000)

    def level(units):
        s = strength(units.values())
        return {k: (b + s * m) / (n + s) for k, (n, b, m) in units.items()}, s

    def summed(cut, means):
        out = {}
        for h, (n, b) in hosts.items():
            key = ".".join(h.split(".")[-cut:])
            have = out.get(key, (0, 0))
            out[key] = (have[0] + n, have[1] + b)
        return {k: (n, b, means(k)) for k, (n, b) in out.items()}

    total = sum(n for n, _ in hosts.values())
    m0 = (sum(b for _, b in hosts.values()) + 0.5) / (total + 1)
    suffixes, _ = level(summed(1, lambda k: m0))
    domains, _ = level(summed(2, lambda k: suffixes[k.split(".")[-1]]))
    units = {h: (n, b, domains[".".join(h.split(".")[-2:])]) for h, (n, b) in hosts.items()}
    rates, s = level(units)
    return {h: (r, r - z * (r * (1 - r) / (units[h][0] + s + 1)) ** 0.5) for h, r in rates.items()}


def test_reputation_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for h in range(120):
        host = f"h{h}.d{h % 13}.{rng.choice(('com', 'net', 'zz'))}"
        odds = 0.9 if host.endswith("zz") else 0.1 + 0.05 * (h % 13)
        rows += [(host, int(rng.random() < odds)) for _ in range(rng.choice((1, 3, 40)))] if h % 4 else [(host, None)]
    got = {r.host: (r.rate, r.bound) for r in ur.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = reputation_oracle(rows, ur.Z)
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for h in want for a, b in zip(got[h], want[h], strict=True))


def test_unlabelled_hosts_follow_the_names_above(spark):
    """A new host of a domain, and a new domain of a suffix, that are all bad are blocked; elsewhere they are allowed."""
    urls = [f"http://h{i % 50}.spam{i % 5}.zz/a" for i in range(200)] + [f"http://h{i % 50}.fine.com/a" for i in range(200)] + ["http://new.spam1.zz/", "http://a.fresh.zz/", "http://new.fine.com/", "http://a.fresh.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in ur.judge_pages(pages, outcomes).collect()}
    assert [got[i] for i in (400, 401, 402, 403)] == ["block", "block", "allow", "allow"]
    suffixes = {r.suffix for r in ur.with_domains(spark.createDataFrame([("a.b.pvt.k12",)], "host string"), ["pvt.k12"]).collect()}
    assert suffixes == {"pvt.k12"}


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    common, docs = "a line that is common", []
    docs += [(1, common), (5, f"x\n{common}\nz"), (5, "first line of all\nunique second line kept\nthird line of all")]
    many = "\n".join([common, "own"] * 20000)
    docs += [(9, many)]
    got = {(r.doc_id, r.text, r.n_dropped) for r in ld.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as t", "2 as lost_pos")).collect()}
    assert got == {(1, common, 0), (5, "x\nz", 1), (*docs[2], 0), (9, "\n".join(["own"] * 20000), 20000)}


def test_languages_against_a_fresh_coder_a_piece(spark):
    """Verdicts and margins again, with one new compressor for each piece and language; dictionaries against middles cut by hand."""
    import zstandard

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(LANGS[x]) for _ in range(rng.choice((3, 40, 900)))), x) for i in range(90) for x in [rng.choice(sorted(LANGS))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = cl.learn(docs)
    for lang, content in dictionaries:
        middles = []
        for _, text, x in rows:
            if x == lang:
                start = max(0, len(text) // 2 - 512 - 1)
                middles.append(cl.letters(text[start : start + 1024]))
        assert len(content.decode()) == sum(map(len, middles)) + len(middles) - 1 and all(m in content.decode() for m in middles)
    counts = {lang: sum(x == lang for _, _, x in rows) for lang, _ in dictionaries}
    assert [lang for lang, _ in dictionaries] == sorted(counts, key=lambda x: (-counts[x], x))

    def judged(text):
        clean = "".join(c if c.isalpha() else " " for c in text.lower())
        clean = " ".join(clean.split(" ")) if "  " not in clean else cl.letters(text)
        sizes = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(b" " * 8 + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(clean[i : i + 1536].encode())) for i in range(0, len(clean), 1536)))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min(s for i, s in enumerate(sizes) if i != best)
        return dictionaries[best][0], (rest - sizes[best]) / rest

    texts = {i: text for i, text, _ in rows} | {500: "der the eau 12 und, ing", 501: "x" * 5000, 502: "the ing and " * 700}
    got = cl.classify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), dictionaries).collect()
    for r in got:
        lang, margin = judged(texts[r.doc_id])
        assert (r.lang_pred, r.rejected) == (lang, margin < 0.004) and abs(r.score - margin) < 1e-12


def test_clashing_names_in_any_case(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a line of words\nb", "s", 0, 0), (2, "a line of words", "s", 0, 0)], "doc_id long, text string, source string, N_Lines int, N_DROPPED int")
    out = ld.drop_repeated_lines(docs)
    out.write.parquet(str(tmp_path / "lines"))
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()} == {(1, 2, 0), (2, 1, 1)}
    more = spark.createDataFrame([(i, "t", "s", 5.0, 1, "k") for i in range(20)], "doc_id long, text string, source string, Rate double, Copy int, Shuffle_KEY string")
    mixed = sm.mix_sources(more)
    mixed.write.parquet(str(tmp_path / "mixed"))
    assert mixed.where("rate = 5.0").count() == 0 and mixed.count() > 0
