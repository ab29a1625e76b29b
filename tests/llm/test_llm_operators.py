"""Every operator against brute force or its library, with odd texts, null keys, repeated rows and no rows."""

import zlib
from collections import defaultdict

import numpy as np
import plain
import pytest
from plain import ODD

from dossierflow.llm import fingerprints, html_text, licenses, ngram_join, packing, quality_model, quality_rules, sentence_pieces
from dossierflow.llm import token_counts, toxicity
from dossierflow.llm.queries import tokenizer_file


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return plain.table(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_join(spark, docs, n, percent):
    got = rows(ngram_join.joined(docs, n=n, percent=percent))
    assert got == sorted(plain.joined(pairs(docs), n, percent), key=str)


def test_join_odd(spark, odd):
    named = [(k, t) for k, t in pairs(odd) if k is not None]
    want = sorted([*plain.joined(named), (None, 1, None)], key=str)  # two words without a key
    assert rows(ngram_join.joined(odd)) == want
    assert rows(ngram_join.joined(plain.empty(spark))) == []


def test_join_chain_of_copies(spark):
    """Copies of one text with one other word each link with the original only, and some only with each other."""
    base = [f"w{i}" for i in range(70)]
    made = [" ".join(base)] + [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 70, 3)]
    walk, steps = base[:], []
    for i in range(5, 65, 6):
        walk[i] = f"step{i}"
        steps.append(" ".join(walk))
    table = list(enumerate(made + steps + [" ".join(base[:40]), "other words entirely here"], 100))
    got = rows(ngram_join.joined(spark.createDataFrame(table, "doc_id long, text string")))
    assert got == sorted(plain.joined(table), key=str)


def test_token_counts_of_many_blocks(spark):
    """More blocks in a task than any fixed number of bits for them: one text each."""
    path = tokenizer_file("byte_bpe_50k.json")
    df = spark.range(9000).selectExpr("id as doc_id", "concat('text ', id, ' of ', id % 7) as text").repartition(2)
    got = rows(token_counts.counts(df, path, block_bytes=1))
    library = token_counts.library(path)
    assert got == sorted(((k, len(t), len(library.encode(t, add_special_tokens=False).ids), False) for k, t in pairs(df)), key=str)


def test_token_counts(spark, docs, odd):
    library = token_counts.library(tokenizer_file("byte_bpe_50k.json"))
    for df in (odd, docs.limit(200).union(docs.limit(3))):
        want = []
        for key, text in pairs(df):
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            want.append((key, len((text or "").encode()), n, n > 1024))
        assert rows(token_counts.counts(df, tokenizer_file("byte_bpe_50k.json"), block_bytes=1 << 16)) == sorted(want, key=str)
    assert rows(token_counts.counts(plain.empty(spark), tokenizer_file("byte_bpe_50k.json"))) == []


def test_packing(spark, docs, odd):
    path = tokenizer_file("word_bpe_49k.json")
    library = token_counts.library(path)
    df = docs.select("doc_id", "text").union(odd.where("doc_id is not null").selectExpr("doc_id + 1000000", "text").distinct())
    ids = {k: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in pairs(df)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed(df.repartition(3), path, 2).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for key, found in pieces.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            part = ids[key][p.start : p.start + p.length]
            assert p.start == at and p.length == len(part) > 0 and p.doc_tokens == len(ids[key])
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[key])
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    repeated = packing.packed(plain.table(spark, ["a b", None]), path, 2).collect()
    assert sum(r.length for r in repeated) == 3 + 1 + 3 + 1  # repeated and keyless rows are packed too
    assert packing.packed(plain.empty(spark), path, 2).collect() == []


def test_packing_limits():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 900, 400)
    prompt = rng.integers(0, 400, 400)
    limits = packing.Limits(tokens=512, segments=4, loss=300)
    found, _ = packing.fill(packing.Examples([0] * 400, size, prompt), limits, 0, True)
    used = defaultdict(lambda: np.zeros(3, int))
    for p in found:
        loss = max(0, p.start + p.length - max(p.start + 1, int(prompt[p.example])))
        used[p.sequence] += (p.length, 1, loss)
    assert sum(u[0] for u in used.values()) == size.sum()
    assert all((u <= np.array(limits)).all() for u in used.values())


def test_quality_rules(spark, docs, odd):
    for df in (odd, docs):
        got = rows(quality_rules.judged(df))
        want = []
        for key, text in pairs(df):
            m = plain.measures(text)
            want.append((key, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
        assert sorted((r[:7] for r in got), key=str) == sorted(want, key=str)
        kept = {r[0] for r in got if r[7]}
        assert not any(r[6] and r[7] for r in got)
        assert {k for k, _ in pairs(quality_rules.kept_rows(df))} == kept
    assert quality_rules.kept_rows(odd).columns == odd.columns
    assert rows(quality_rules.judged(plain.empty(spark))) == [] == rows(quality_rules.kept_rows(plain.empty(spark)))


def test_quality_rules_order(spark, docs):
    cheap = quality_rules.Rule("cheap", lambda v: v.n_symbols() > 0)
    never = quality_rules.Rule("never", lambda v: v.n_words() < 0)
    assert [r.name for r in quality_rules.ordered(docs, (never, cheap))] == ["cheap", "never"]
    first, last = (quality_rules.kept_rows(docs, order).count() for order in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert first == last > 0


def test_html_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_text.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = r.html.split("<article>")[-1].split("</article>")[0]
        assert r.n_chars == len(r.text) and "track(" not in r.text and "&middot;" not in r.text
        import html
        import re

        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no markup", "no markup"),
        ("<p>a <b>b</b>c<br>d&nbsp;&amp;&#233;</p>", "a bc d &é"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>one<p>two <a>link</a></article><footer>f</footer>", "T\none\ntwo link"),
        ("<div class='ad'>buy<article><p>text</p></article>", "text"),
        ("<article><p>a</p><section id='comments'><p>great</p></section><div class=share>s</div><p>b</p></article>", "a\nb"),
        ("<main><header><h1>T</h1><i>by x</i></header><p>a</p><form>f<input></form></main>", "T\na"),
        ("<script>var t='</p>'; if (a<b) x</script><style>p{}</style><p>a</p><!-- c <p>no</p> -->", "a"),
        ("<aside>side</aside><div role=alert>!</div><p hidden>h</p><p style='display: none'>h</p><p>a</p>", "a"),
        ("<article><p>a < b &lt;i&gt; c</p><p>cut <a hre", "a < b <i> c\ncut"),
    ],
)
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><p>text</p></main><aside class=sidebar><article><p>teaser</p></article></aside>", "text"),
        ("<article><p>text</p></article><div id=comments><ul><li class=comment><article class='comment-body'><p>great</p></article></ul></div>", "text"),
        ("<article class='post has-comments'><p>text</p></article><article id=c7 class=comment-body><p>great</p></article>", "text"),
        ("<article><p>One</p><form><p>a longer text with many more words than the article</p></form></article>", "One"),
        ("<p>before</p><div role=main><p>text</p></div><p>after</p>", "text"),
        ("<p>before</p><div ROLE='main'><p>text</p></div><p>after</p>", "text"),
        ('<p>before</p><div role = "main"><p>text</p></div><p>after</p>', "text"),
        ("<div class=ad>buy<aside>side<article><p>text</p></article>", "text"),
        ("<h1>Title</h1><p>by A</p><p>2024</p><p>place</p><p>{0}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>", "Title\nby A\n2024\nplace\n{0}"),
    ],
)
def test_html_contract(page, text):
    long = " ".join(["words of an article that has no mark"] * 4)
    assert html_text.main_text(page.format(long)) == text.format(long)


def test_html_region():
    long = "long text with many words in it " * 6
    page = f"<div><a href=1>home</a></div><ul><li><a>x</a><li><a>y</a></ul><div><p>{long}</p><p>short</p><p>{long}</p></div><br><div><a>z</a></div>"
    assert html_text.main_text(page) == "\n".join([long.strip(), "short", long.strip()])


WORDS = [f"paragraph {i} of a text that has some more words in it than a menu, a share box or an advert has" for i in range(4)]


@pytest.mark.parametrize(
    "page, lines",
    [
        ("{0}{1}<div class=ad><p>buy<p>this<p>now</div>{2}{3}", WORDS),
        ("{0}{1}<ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>{2}{3}", WORDS),
        ("<div class='content has-sidebar'>{0}</div><div class=sidebar>s</div>", WORDS[:1]),
        ("<div id='page-header-fixed'><div class='site-header'>h</div><div class='c-cookie-banner'>c</div>{0}</div><p class='ad-300x250'>a", WORDS[:1]),
        ("<form id=aspnetForm role=form><nav>menu</nav>{0}{1}</form>", WORDS[:2]),
        ("<main><form>{0}{1}</form></main>", WORDS[:2]),
        ("<form>{0}<article>{1}</article></form>", WORDS[1:2]),
        ("{0}{1}<form>name <input> mail <input></form>", WORDS[:2]),
        ("<div aria-hidden=false data-hidden style='overflow: hidden'>{0}</div>", WORDS[:1]),
        ("<div title='hidden' class='display:none' hidden=until-found>{0}</div>", WORDS[:1]),
        ("{0}<div HIDDEN>{1}</div><div hidden=''>{1}</div><div style='color:red;DISPLAY : none !important'>{1}</div>", WORDS[:1]),
    ],
)
def test_html_loses_no_text(page, lines):
    assert html_text.main_text(page.format(*(f"<p>{x}</p>" for x in WORDS))) == "\n".join(lines)


def test_html_odd(spark):
    schema = "page_id long, url string, html string, text string"
    table = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>a</p>", "t"), (1, "u", None, "t")], schema)
    assert rows(html_text.extracted(table)) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1)]
    assert rows(html_text.extracted(table.limit(0))) == []
    deep = "<b>" * 50000 + "x" + "</i>" * 50000
    assert html_text.main_text(deep) == "x"


def test_fingerprints(spark, docs, odd):
    for df in (docs.limit(150), odd, odd.limit(1)):
        df = df.select("doc_id", "text").cache()
        assert rows(fingerprints.fingerprinted(df)) == plain.fingerprints(pairs(df))
    assert rows(fingerprints.fingerprinted(plain.empty(spark))) == []


def test_fingerprints_of_scattered_keys(spark):
    keys = [-(2**63), 2**63 - 1, 0, 50, 51, 1024, 10**12, 10**12 + 1, -7, -(10**15)]
    table = [(k, f"text number {i} of ten " * (i + 1)) for i, k in enumerate(keys)]
    assert rows(fingerprints.fingerprinted(spark.createDataFrame(table, "doc_id long, text string"))) == plain.fingerprints(table)


def test_near_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    flip = lambda x, bits: signed((x % 2**64) ^ sum(1 << int(b) for b in bits))
    prints = base + [flip(x, rng.choice(64, k, False)) for x in base for k in (1, 2, 3, 4, 5)]
    table = spark.createDataFrame([(x, 2) for x in prints], "fingerprint long, copies long")
    got = dict(map(tuple, fingerprints.near(table, table.limit(60)).collect()))
    far = lambda a, b: bin((a ^ b) % 2**64).count("1")
    assert got == {q: 2 * sum(far(q, x) <= 3 for x in prints) for q in prints[:60]}


def test_pieces(spark, docs, odd):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_file("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    for df in (odd, docs.limit(150)):
        want = [(k, library.encode(t or "")) for k, t in pairs(df)]
        ids = sentence_pieces.encoded(df, path)
        assert rows(ids) == sorted(want, key=str)
        back = {k: t for k, t in pairs(df)}
        assert all(r.text == (back[r.doc_id] or "").replace("▁", " ") for r in sentence_pieces.decoded(ids, path).collect())
        for r in sentence_pieces.digested(df, path).collect():
            assert r.round_trip == ("▁" not in (back[r.doc_id] or ""))
            if r.doc_id is not None:
                assert r.ids_crc32 == zlib.crc32(np.array(dict(want)[r.doc_id], "<u4").tobytes())
    assert rows(sentence_pieces.digested(plain.empty(spark), path)) == []


def test_rebuilt_unigram():
    """A unigram model takes its scores over; the best segmentation follows them."""
    pieces = [sentence_pieces.Piece("<unk>", 0, 2), *(sentence_pieces.Piece(t, s, 1) for t, s in [("▁ab", -1.0), ("▁a", -3.0), ("b", -3.0), ("c", -2.0)])]
    model = sentence_pieces.Model(pieces, 1, False, b"", True, False, True)
    tokenizer = sentence_pieces.rebuilt(model)
    assert tokenizer.encode("abc ab").tokens == ["▁ab", "c", "▁ab"]
    assert tokenizer.decode(tokenizer.encode("abc ab").ids) == "abc ab"


def test_licenses(spark, odd):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files"
    texts = [
        "Released under the MIT License. Under the MIT  license!", "under the mit", "CC-BY-NC 4.0", "cc by", mit, mit[:60],
        "licensed under the Apache License, Version 2.0", "Licensed under the GNU General Public License, version 3.", None, "", "mit",
    ]
    got = {r.doc_id: r for r in licenses.scanned(plain.table(spark, texts)).collect()}
    labels = ["mit", "", "cc-by-nc", "", "mit", "", "apache-2", "gpl-3", "", "", ""]
    assert [got[i].labels for i in range(11)] == labels
    assert [got[i].base_labels for i in range(11)] == ["mit", "", "cc-by-nc", "", "", "", "apache-2", "", "", "", ""]
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].n_words) == (2, 1, 5, 9)
    assert 0.8 <= got[4].score <= 1 and got[10].score == 0 and got[10].first_word is None
    assert licenses.scanned(odd).count() == odd.count()
    assert rows(licenses.scanned(plain.empty(spark))) == []


def auc(score, good):
    order = np.argsort(np.argsort(score))
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_quality_model(spark, docs, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.learned_and_scored(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy() == 1) > 0.95
    assert ((held.predicted == held.quality).mean()) > max(held.quality.mean(), 1 - held.quality.mean())
    assert ((got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)) == got.held_out).all()
    found = quality_model.learned_and_scored(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    same = {r.score for r in found if r.doc_id in (16, 17)}
    assert len(same) == 1
    assert rows(quality_model.learned_and_scored(plain.empty(spark), labels.limit(0))) == []
    assert {r.score for r in quality_model.learned_and_scored(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    bad = ["idiot", "moron", "vejuble", "vejutte"]
    texts, labels = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.integers(0, 40, 1 + i % 7):
                w[k] = bad[i // 5 % 4]
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    df = plain.table(spark, texts)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(df, marks.where("doc_id < 400"))
    got = {r.doc_id: r for r in toxicity.scored(df, models).collect()}
    held = range(400, 600)
    assert all(got[i].rejected == (i % 5 == 0) for i in held)
    assert all(0 <= got[i][f"p_{c}"] <= 1 for i in held for c in toxicity.CATEGORIES)
    clean = toxicity.clean_rows(df, models)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect() if r.doc_id is not None} == {i for i in got if i is not None and not got[i].rejected}
    odd = plain.table(spark, ODD)
    assert toxicity.scored(odd, models).count() == odd.count()
    assert toxicity.clean_rows(odd, toxicity.fit(odd, marks.limit(0))).count() == odd.count()
    assert rows(toxicity.scored(plain.empty(spark), models)) == []
