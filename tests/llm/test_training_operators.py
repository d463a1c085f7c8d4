"""Operators that SQL can't express: brute force, exact round trips and held-out accuracy on small tables."""

import collections
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from brute import brute_links
from pyspark.sql import functions as F

from memlake.llm import ann, html, licenses, mixing, neighbours, packing, quality, toxicity
from memlake.llm import components as components_
from memlake.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 1), (4, "same text here now ok", "en", None, 1), (4, "same text here now ok", "en", None, 1), (5, "same text here now ok", None, "s", 1), (None, "no id", "en", "s", 5)]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], DOCS + ", score string, quality double")


# --- packing


def test_tokenizer_twins_agree(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in documents.select("text").collect()] + ["", "<|endoftext|>", "hi <|endoftext|> there", "<|ENDOFTEXT|>", " \n\t  x", "é ü 漢字 👍🏽", "a" * 5000, "'s 't don't", "x  " * 100]
    assert all(fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("which", ["documents", "odd", "empty"])
def test_packing_places_every_id_once(spark, documents, which):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = {"documents": documents, "odd": odd_documents(spark), "empty": documents.limit(0)}[which]
    rows = packing.pack_texts(docs, path).collect()
    encode = packing.encoder(path)
    ids = [(r.doc_id, np.append(encode(r.text or ""), 0).astype("<u4")) for r in docs.select("doc_id", "text").collect()]
    want = collections.Counter()
    for doc, x in ids:
        want[doc] += len(x)
    assert sum(r.length for r in rows) == sum(want.values())
    texts = dict(ids)
    by_seq = collections.defaultdict(list)
    for r in rows:
        own = texts[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.length > 0
        by_seq[r.sequence_id].append((r.offset, r.length))
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding <= 0.01 * total + 1024
    assert len(by_seq) == len(set(by_seq))


def test_tiny_documents_fill_sequences_too(spark):
    import public_tokenizers

    docs = spark.range(0, 6000, 1, 4).selectExpr("cast(id as string) as doc_id", "concat('a ', id % 7) as text")
    rows = packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    lengths = collections.Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    total = sum(lengths.values())
    assert {r.doc_id for r in rows} == {str(i) for i in range(6000)} and sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths.values()) <= 0.02 * total


def test_instruction_rows_against_a_bound(spark):
    """Conversations as examples: tokens are words, those of assistants bear loss; no packing can use fewer sequences than each limit alone asks for."""
    words = F.size(F.split("text", r"\\s+"))
    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").groupBy(F.col("conv_id").alias("example_id")).agg(F.sum(words).cast("long").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).cast("long").alias("loss_tokens"))
    limit, loss = 4096, 1536
    rows = rows.where(f"tokens <= {limit} and loss_tokens <= {loss}").coalesce(1)
    items = {r.example_id: r for r in rows.collect()}
    out = packing.pack_examples(rows, limit, 12, loss).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r.example_id)
    assert sorted(r.example_id for r in out) == sorted(items)
    for keys in by.values():
        assert sum(items[k].tokens for k in keys) <= limit and sum(items[k].loss_tokens for k in keys) <= loss and len(keys) <= 12
    least = max(sum(r.tokens for r in items.values()) / limit, sum(r.loss_tokens for r in items.values()) / loss, len(items) / 12)
    assert len(by) <= 1.15 * least + 1


def test_instruction_packing_keeps_every_limit():
    r = np.random.RandomState(1)
    packer = packing.Packer(1000, 8, 400, cut=False, pool=64)
    items = {i: (int(r.randint(1, 700)), 0) for i in range(500)}
    items = {i: (n, int(r.randint(0, min(n, 400) + 1))) for i, (n, _) in items.items()}
    out = [p for i, (n, k) in items.items() for p in packer.add(i, n, k)] + list(packer.finish())
    assert sorted(p[0] for p in out) == sorted(items)
    by = collections.defaultdict(list)
    for key, _, n, seq, _ in out:
        by[seq].append(key)
    for keys in by.values():
        assert sum(items[k][0] for k in keys) <= 1000 and sum(items[k][1] for k in keys) <= 400 and len(keys) <= 8
    least = max(sum(n for n, _ in items.values()) / 1000, sum(k for _, k in items.values()) / 400)
    assert len(by) <= 1.2 * least
    with pytest.raises(ValueError):
        list(packer.add("long", 1001, 1))


def test_pack_examples_on_spark(spark):
    df = spark.createDataFrame([(i, 100 + i, i) for i in range(50)], "example_id long, tokens long, loss_tokens long")
    rows = packing.pack_examples(df, 1024, 16, 512).collect()
    assert sorted(r.example_id for r in rows) == list(range(50))


# --- near duplicates


def test_join_equals_brute_force(spark, documents):
    base = [f"w{i}" for i in range(120)]
    r = np.random.RandomState(3)
    extra = []
    for i in range(60):  # a group larger than a block when BLOCK is small, with similarities around the threshold
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randint(120)] = f"x{r.randint(1000)}"
        extra.append((10_000 + i, " ".join(words)))
    rows = [tuple(x) for x in documents.select("doc_id", "text").collect()] + extra + [(20_000, ""), (20_001, None), (20_002, "a b"), (20_003, "A  b"), (20_004, "a b c")]
    out = neighbours.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_shingles) for x in out} == brute_links(rows)


def test_blocks_of_large_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    r = np.random.RandomState(4)
    rows = []
    for i in range(50):
        words = [f"w{j}" for j in range(100)]
        words[r.randint(100)] = f"y{i}"
        words[r.randint(100)] = f"z{i}"
        rows.append((i, " ".join(words)))
    out = neighbours.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_shingles) for x in out} == brute_links(rows)


def test_whole_sets_compared_in_products():
    r = np.random.RandomState(5)
    sets = lambda n: [np.unique(r.choice(4000, r.randint(1, 3000), replace=False)).astype(np.uint64) for _ in range(n)]
    a, b = sets(20), sets(30)
    b[0], b[1] = a[3], np.append(a[4][: len(a[4]) * 9 // 10], np.uint64(9000))
    want = [[5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for y in b] for x in a]
    assert neighbours.similar(a, b, columns=257).tolist() == want and want[3][0] and want[4][1]
    assert not neighbours.similar([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).any()


def test_query_equals_brute_force(spark, documents):
    out = neighbours.op10_ngram_jaccard_join(spark, SF).collect()
    assert {x.doc_id: (x.class_id, x.n_links, x.n_shingles) for x in out} == brute_links([tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_odd_and_empty_tables(spark, documents):
    out = neighbours.near_duplicates(odd_documents(spark)).collect()
    assert len(out) == 7 and {r.n_links for r in out if r.doc_id in (4, 5)} == {2}
    assert neighbours.near_duplicates(documents.limit(0)).count() == 0
    kept = neighbours.keep_one_of_each(odd_documents(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"] and kept.columns == odd_documents(spark).columns


def test_one_of_each_where_ids_repeat_with_other_texts(spark):
    word = lambda seed: " ".join(f"w{int(x)}" for x in np.random.RandomState(seed).randint(0, 10**6, 60))
    a, b, c, d = map(word, range(4))
    near = f"{d} more"
    rows = [(2, a), (4, a), (4, b), (4, b), (5, c), (5, d), (5, near), (6, c), (7, near), (None, b), (8, ""), (8, "")]
    kept = neighbours.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), "d" if r.text in (d, near) else r.text) for r in kept)
    assert got == sorted([("2", a), ("4", b), ("5", c), ("5", "d"), ("None", b), ("8", "")])


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = neighbours.fewest_matches()
    assert list(fewest) == sorted(fewest) and fewest[0] < 0.8 * neighbours.ROUND and fewest[-1] > 0.4 * neighbours.ROUND * len(fewest)


def test_components(spark, monkeypatch):
    star = [(7, i) for i in range(1000, 1700)] + [(i, i + 1) for i in range(1690, 1750)]
    monkeypatch.setattr(components_, "HUB", 4)
    out = {r.node: r.comp for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert set(out.values()) == {7} and set(out) == {7, *range(1000, 1751)}
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (100, 102), (200, 200)]
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# --- neighbours of vectors


def test_recall_ties_and_odd_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.search(rows, rows.where("vec_id % 20 = 0")).collect()
    data = rows.collect()
    ids = np.array([r.vec_id for r in data])
    x = np.array([r.embedding for r in data], dtype=float)
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert len(by[q]) == 20 and all(abs(score - s[ids == v][0]) < 1e-12 for v, score in by[q])
        assert [v for v, _ in by[q]] == [v for v, _ in sorted(by[q], key=lambda p: (-p[1], p[0]))]
        hits += len({v for v, _ in by[q]} & set(ids[order]))
    assert hits >= 0.9 * 20 * len(by)
    odd = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (20, [0.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, score int")
    out = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()}
    assert out == {(0, 1): (1, 2.0), (0, 2): (2, 2.0), (0, 3): (20, 0.0), (20, 1): (0, 0.0), (20, 2): (1, 0.0), (20, 3): (2, 0.0)}
    assert ann.search(df.limit(0), df).count() == 0
    same = spark.createDataFrame([(i % 3, [1.0, float(i % 2)], "clash") for i in range(12)], "vec_id long, embedding array<double>, score string")
    out = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(same, same.where("vec_id = 0").limit(1)).collect())
    assert [x[2] for x in out] == sorted((x[2] for x in out), reverse=True) and sorted(x[1] for x in out) == [1, 1, 1, 1, 2, 2, 2, 2]


def _embeddings(spark, n):
    """Vectors like those of the tables: unit length, most without structure, some of them copies."""
    r = np.random.RandomState(n)
    x = r.normal(size=(n, 64))
    x[::17] = x[: len(x[::17])] + 0.01 * r.normal(size=x[::17].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    return ids, x, spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("n", [3000, 12_000])
def test_neighbour_query_against_brute_force(spark, tmp_path, n):
    """Recall of the query itself at two sizes, the larger one of several blocks, and how many rows it verifies."""
    ids, x, rows = _embeddings(spark, n)
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = ann.op9_nearest_neighbours(spark, str(tmp_path)).collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for at in range(0, n, 20):
        s = x @ x[at]
        s[at] = -np.inf
        hits += len(found[at] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits >= 0.9 * 20 * len(found) and len(found) == n // 20
    assert np.mean([r.verified for r in out]) < 0.3 * min(n, ann.BLOCK)


def test_neighbours_are_the_same_however_rows_arrive(spark):
    ids, x, _ = _embeddings(spark, 2000)
    block = ann.Block(ids, x, 1.0, 0.1, 20)
    ask = np.arange(0, 2000, 7)
    said = lambda order: {int(q): (v.tolist(), n) for q, v, _, n in block.search(ask[order], x[ask[order]])}
    assert said(np.arange(len(ask))) == said(np.arange(len(ask))[::-1]) == said(np.random.RandomState(1).permutation(len(ask)))


def test_settled_deletes_its_own_tables_alone(spark):
    """Calls in threads, and calls inside calls, leave each other's tables."""
    import threading

    from memlake.llm import shared

    other, gate, done = [], threading.Event(), threading.Event()

    def run():
        def make():
            other.append(shared.cut(spark.range(3), "other"))
            gate.set()
            done.wait(60)
            return other[0]

        other.append(shared.settled(make, "others"))

    thread = threading.Thread(target=run)
    thread.start()
    gate.wait(60)
    inner = []
    out = shared.settled(lambda: inner.append(shared.cut(spark.range(5), "inner")) or shared.settled(lambda: inner[0].where("id > 1"), "deep"), "outer")
    assert out.count() == 3 and other[0].count() == 3
    done.set()
    thread.join()
    assert other[1].count() == 3
    with pytest.raises(Exception, match="exist"):
        inner[0].count()


# --- pages


PAGES = {
    "": "",
    "<p>just &amp; text</p>": "just & text",
    "<div class='cookie-notice'>We use cookies</div>": "",
    "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One  two\nthree.<p>Four&nbsp;five<br>six.</p><script>var x='</p>'</script><aside>Related words</aside><p>Of.</p></article><footer>foot</footer>": "T\nOne two three.\nFour five six.\nOf.",
    "<body><header>Site name</header><div id='mainContent'><h2>Head</h2><p>Body text of some length stands here.</p><div class='ad-slot'>buy this now</div><p>End.</p><ol class='comment-list'><li>I disagree with all of this</li></ol></div><div class='sidebar'>side words here</div>": "Head\nBody text of some length stands here.\nEnd.",
    "<article><p>a &lt; b</p><!-- <p>no</p> --><table><tr><td>1<td>2</table><form>Name <input></form></article>": "a < b\n1\n2",
    "<div class=nav><article><p>Inside an element never closed</p></article>": "Inside an element never closed",
    "<article><p>cut off <a href='x": "cut off",
}


def test_main_text_below_unclosed_boilerplate():
    text = "A text of the article that is long enough to be the main text of its page, in one paragraph."
    links = "<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>"
    for inner in (f"<article><p>{text}</p></article>", f"<main><p>{text}</p></main>", f"<div id=content><p>{text}</p></div>"):
        assert text in html.main_text(f"<body><h1>Site</h1><div class=nav>{links}{inner}</body>"), inner
        assert html.main_text(f"<body><p>{text} First.</p><div class=related>{links}{inner}</div></body>") == f"{text} First."
        assert text not in html.main_text(f"<body><h1>Site</h1><div class=nav>{links}<div class=related>{inner}</div></body>")
        assert html.main_text(f"<body><p>{(text + ' ') * 3}</p><div class=nav>{links}</div><p>{text} Last.</p></body>").endswith("Last.")


def test_main_text():
    assert {p: html.main_text(p) for p in PAGES} == PAGES
    assert html.main_text(None) == "" and html.main_text("<" * 5000) is not None


def test_names_alone_decide_nothing():
    text = "A text of the article that is long enough to be the main text of its page, in one paragraph."
    menu = "".join(f"<li><a href=/{i}>Menu entry {i} here</a></li>" for i in range(9))
    said = "<p>I disagree with all of this, as it seems to me rather wrong.</p>"
    body = f"<h1>Title</h1><p>{text}</p>"
    only = f"Title\n{text}"
    pages = {
        f"<body><div class='x7k'><ul>{menu}</ul></div><div>{body}</div></body>": only,
        f"<body><div class='x7k'>{menu.replace('li>', 'div>').replace('<a href=', '<i x=').replace('/a>', '/i>')}</div><div>{body}</div></body>": only,
        f"<article><div class='x7k'><ul>{menu}</ul></div>{body}</article>": only,
        f"<body><nav>{menu}</nav><div class='content ad-free'>{body}</div></body>": only,
        f"<body><div class='share-price-table'>{body}</div></body>": only,
        f"<article>{body}<div class='share-price-table'><table><tr><td>Acme<td>12</table></div></article>": only + "\nAcme\n12",
        f"<article>{body}</article><article class='comment'>{said}</article>": only,
        f"<main>{body}<article class='comment'>{said}</article><div class='post-comments'>{said}</div></main>": only,
        f"<article>{body}</article><article class='advert'>{said}</article>": only,
        f"<article hidden><p>{said}</p></article><article>{body}</article>": only,
        f"<body><div class='menue'><ul>{menu}</ul></div><div class='inhalt'>{body}</div><div class='kommentare'>{said}{said}</div></body>": only,
        f"<body><form id=all><nav>{menu}</nav><div>{body}</div></form></body>": only,
        "<article><p>" + "<b>" * 12 + "one two three four<div>five six seven eight</div></article>": "one two three four\nfive six seven eight",
    }
    assert {p: html.main_text(p) for p in pages} == pages


def test_weights_learned_from_the_table(spark):
    text = "A text of the article that is long enough to be the main text of its page, number {}."
    said = "<div class='qqrest'><p>Some words that stand beside the text of every page, and tell nothing of it.</p></div>"
    rows = [(i, "u", f"<body>{said}<article><div class='zztext'><p>{text.format(i)}</p></div></article></body>", "clash") for i in range(60)]
    weights = html.learn(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert weights.element["name qqrest"] < html.BOILERPLATE and weights.element["name zztext"] > html.CONTENT and weights.taught == {"name qqrest", "name zztext"}
    page = f"<body><div class='zztext'><p>{text.format(7)}</p></div>{said}</body>"
    assert html.main_text(page, weights) == text.format(7) and "beside" in html.main_text(page)
    wrapped = f"<body><div class='qqrest'><article><p>{text.format(1)}</p></article></div></body>"  # what holds an article is not dropped by such a name
    assert html.main_text(wrapped, weights) == text.format(1)


def best_region(scores):
    """All regions, by their sums."""
    sums = [(sum(scores[a : b + 1]), -a, -b) for a in range(len(scores)) for b in range(a, len(scores))]
    best = max(sums, default=(0, 0, 0))
    return best[0] if best[0] > 0 else 0.0


def test_region_against_all_regions():
    r = np.random.RandomState(6)
    for _ in range(60):
        scores = (r.normal(size=r.randint(0, 30)) * 3).round(3).tolist()
        best, region = html._best(scores)
        assert abs(best - best_region(scores)) < 1e-9 and (region is None) == (best == 0)
        assert region is None or abs(sum(scores[region[0] : region[1] + 1]) - best) < 1e-9


def test_odd_pages(spark):
    long = "<article>" + "<p>word and word again.</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>One two three.</p></article>"), (3, "u", "<article><p>One two three.</p></article>"), (None, "u", "plain words alone"), (4, "u", long), (5, "u", "<div>" * 6000 + "</x>" * 6000), (6, "u", "</p></div>< <> &amp; <!--")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted((str(r.page_id), r.text) for r in html.extract(df).collect())
    assert out == sorted([("1", ""), ("2", ""), ("3", "One two three."), ("3", "One two three."), ("None", "plain words alone"), ("4", "\n".join(["word and word again."] * 20_000)), ("5", ""), ("6", "< <> &")])
    assert html.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    import re
    from html import unescape

    rows = html.op8_html_extraction(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- classifiers


def test_toxicity_on_held_out_rows(spark, larger, labels):
    weights, bias = toxicity.fit(larger, labels)
    out = toxicity.with_toxicity(larger.select("doc_id", "text"), weights, bias).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    right = [(r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in out]
    assert len(right) > 80 and np.mean(right) > 0.9
    odd = toxicity.with_toxicity(odd_documents(spark), weights, bias, "p").collect()
    assert len(odd) == 7 and len({r.p for r in odd if r.doc_id in (1, 2)}) == 1
    nothing = toxicity.fit(larger, labels.limit(0))
    assert nothing[0] == {} and toxicity.with_toxicity(larger.limit(0), *nothing).count() == 0


def test_toxicity_query(spark, tmp_path):
    out = {r.doc_id: r for r in toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").collect()}
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert set(out) == set(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    right = [out[r.doc_id].predicted == r.toxic for r in labels if out[r.doc_id].held_out]
    assert len(right) > 80 and np.mean(right) > 0.9
    # held-out labels and other columns change nothing
    spark.createDataFrame([(d.doc_id, d.text, "xx", "yy", 0) for d in docs.values()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if out[r.doc_id].held_out else r.toxic) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    assert max(abs(again[i] - out[i].score) for i in out) < 1e-9


def test_terms_are_counted_over_all_texts(spark):
    rows = spark.createDataFrame([("toxin in here",)] * 500 + [("toxins there",), ("plain",), ("",), ("toxin toxin",)], "text string").repartition(7)
    counts, n = toxicity.document_counts(rows, ["here", "toxi*", "toxin"])
    assert n == 5 and {r.word: r.b for r in counts.collect()} == {"here": 1, "toxi*": 3, "toxin": 2}


def test_nonnegative_risk_learns_from_unlabelled_rows():
    r = np.random.RandomState(0)
    y = r.rand(4000) < 0.2
    x = np.stack([np.where(y, r.rand(4000) < 0.8, r.rand(4000) < 0.02), r.rand(4000) < 0.5], axis=1).astype(float)
    w = toxicity.fit_nnpu(x[:400][y[:400]], x[400:], 0.2)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.mean((p > 0.5) == (x[:, 0] > 0)) > 0.99


def test_quality_and_shrinkage(spark, larger, labels):
    model = quality.fit(larger, labels)
    scored = quality.with_quality(larger, labels).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == bool(r.label) for r in scored]) > 0.85
    rows = [("a", "a/x", 0.9)] * 200 + [("b", "b/x", 0.1)] * 200 + [("c", "c/x", 0.1)] + [("a", "a/y", 0.1)] * 2 + [(None, None, 0.5)]
    sites, (mean, *_) = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.path: r for r in sites.collect()}
    assert abs(got["a/x"].path_posterior - 0.9) < 0.02 and abs(got["b/x"].host_posterior - 0.1) < 0.02
    assert got["c/x"].path_posterior >= 0.1 and None in got and abs(mean - 0.5) < 0.05
    lone = spark.createDataFrame([(1, "a", "x", 0.9), (2, "b", "x", 0.1), (3, "b", "x", 0.1), (4, "b", "y", 0.4)], "doc_id long, _host string, _path string, _p double")
    sites, spread = quality.site_posteriors(lone.selectExpr("_host as host", "_path as path", "_p as p"))
    alone = {r.doc_id: r for r in quality.combine(lone, sites, spread).collect()}
    assert alone[1].host_posterior == alone[1].path_posterior == spread.mean and abs(alone[1].quality - 0.9) < 1e-9  # its own evidence counts once
    assert alone[4].path_posterior == alone[4].host_posterior < spread.mean
    odd = quality.with_quality(odd_documents(spark).drop("quality"), labels)
    assert odd.count() == 7 and model is not None
    assert quality.fit(larger, labels.limit(0)) is None and quality.remove_poor(larger.limit(0), labels).count() == 0


# --- mixing


def test_rates_meet_the_targets(spark, larger, labels):
    domains, solution, rows = mixing.rates(larger, labels)
    assert solution.residual < 1e-6
    data = rows.select("_tokens", "_posterior", mixing.rate_of(solution.steps).alias("rate")).collect()
    a = np.array([r._posterior for r in data]) * np.array([r._tokens for r in data])[:, None]
    rate = np.array([r.rate for r in data])
    want = (a.sum(0) / a.sum()) ** mixing.TEMPERATURE
    assert rate.min() > 1 - 1e-9 and np.allclose(rate @ a / (rate @ a).sum(), want / want.sum(), atol=1e-6)
    truth = {r.doc_id: r.lang for r in larger.collect()}
    best = rows.select("doc_id", "_posterior").collect()
    assert np.mean([domains.names[int(np.argmax(r._posterior))] == truth[r.doc_id] for r in best]) > 0.95
    mixed = mixing.mixed(larger, labels)
    assert mixed.columns == larger.columns and {r.doc_id for r in mixed.select("doc_id").collect()} == set(truth)


def test_query_by_source_and_by_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for domain in ("lang", "source"):
        out = mixing.op3_source_mixing(spark, SF, domain).collect()
        assert {r.doc_id for r in out} == set(docs) and {p.key for p in out[0].posterior} <= {getattr(d, domain) for d in docs.values()}
        names = sorted(p.key for p in out[0].posterior)
        a = np.array([[{p.key: p.value for p in r.posterior}[x] for x in names] for r in out]) * np.array([r.tokens for r in out])[:, None]
        rate = np.array([r.rate for r in out])
        got, want = rate @ a, (a.sum(0) / a.sum()) ** mixing.TEMPERATURE
        assert rate.min() >= 0 and np.allclose(a.sum(1), [r.tokens for r in out])
        assert np.abs(got / got.sum() - want / want.sum()).max() <= out[0].residual * 1.5 + 1e-6


def test_smaller_domains_share_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 3)
    rows = spark.createDataFrame([(i, f"w{i % 6} w{i % 6}", f"d{i % 6}") for i in range(60)] + [(100, "w0", "d0")], "doc_id long, text string, lang string")
    assert mixing.fit_domains(rows, rows.select("doc_id")).names == ["d0", "d1", "other"]
    fitted = mixing.fit_domains(rows, rows.select("doc_id"))
    found: dict[str, int] = {}
    for r in rows.where("lang is not null").collect():
        found[r.lang if r.lang in ("d0", "d1") else "other"] = found.get(r.lang if r.lang in ("d0", "d1") else "other", 0) + 1
    assert np.allclose(np.exp(fitted.prior), [found[x] / sum(found.values()) for x in fitted.names])


def test_projection_keeps_rates_nonnegative(spark):
    r = np.random.RandomState(2)
    p = r.dirichlet([0.5, 0.5, 0.5], 300)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(r.randint(1, 100, 300), p, strict=True)], "_tokens long, _posterior array<double>")
    steps, residual = mixing.solve(rows, 3, [1.0, 0.05, 0.05])
    assert residual >= 0
    data = rows.select("_tokens", "_posterior", mixing.rate_of(steps).alias("r")).collect()
    got = np.sum([np.array(x._posterior) * x._tokens * x.r for x in data], axis=0)
    assert min(x.r for x in data) == 0 and got[0] / got.sum() > 0.8
    assert mixing.mixed(odd_documents(spark), spark.createDataFrame([(3,), (4,)], "doc_id long")).count() >= 7
    assert mixing.mixed(odd_documents(spark).limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


# --- licences


def test_licences(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (3, "Some text.\nReleased under the MIT Licence!\nMore."), (4, mit[:-30]), (5, None), (6, ""), (7, licenses.NOTICES["GPL-3.0"]), (8, "x\n\n" + licenses.TEXTS["0BSD"].replace("\n", " ") + "\n\ny")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")
    out = {(r.doc_id, r.license): (r.n_units, r.whole) for r in licenses.scan(df).collect()}
    assert out == {(1, "MIT"): (1, True), (2, "MIT"): (1, True), (3, "MIT"): (1, False), (7, "GPL-3.0"): (1, True), (8, "0BSD"): (1, False)}
    notices = [(1, "Intro.\n\nLicensed under CC BY 4.0.\n\nEnd."), (2, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.\n\nLicensed  under CC-BY 4.0"), (3, "A\nReleased under the MIT License.\n\nReleased under the MIT Licence.\nB")]
    assert {(r.doc_id, r.license): r.n_units for r in licenses.scan(spark.createDataFrame(notices, "doc_id long, text string")).collect()} == {(1, "CC-BY-4.0"): 1, (2, "CC-BY-4.0"): 3, (3, "MIT"): 2}
    spelled = spark.createDataFrame([("Licence licence licence v. 2.0 and/or non-commercial",)], "t string").select(licenses.normalised(F.col("t"))).first()[0]
    assert spelled == "license license license 2 0 and/or noncommercial"
    assert licenses.scan(df.limit(0)).count() == 0


def test_full_texts_of_licences_in_any_wrapping(spark):
    wrapped = lambda t, n: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    mit, isc = licenses.TEXTS["MIT"], licenses.TEXTS["ISC"]
    isc_lines = isc.replace("above copyright notice", "above\ncopyright notice")
    file = {p.stem: p.read_text() for p in licenses.FILES.glob("*.txt")}
    rows = [(i, name, text) for i, (name, text) in enumerate(sorted(file.items()))]
    rows += [(100 + i, name, f"Readme of a tool.\n\n{wrapped(text, 60)}\n\nThe end.") for i, name, text in rows if name.startswith(("BSD", "Apache", "MPL"))]
    rows += [(200, "MIT", f"MIT License\n\nCopyright (c) 2020 A\n\n{wrapped(mit, 70)}"), (201, "MIT", f"Intro\n\n{wrapped(mit, 70)}\n\nOutro"), (202, "ISC", f"Copyright 2020 A\n\n{isc_lines}"), (203, "MIT", f"{wrapped(mit, 70)}\n\n{wrapped(mit, 50)}")]
    rows += [(300, None, file["GPL-3.0"][:-20000]), (301, None, wrapped(mit, 70).replace("sell", "buy"))]
    out = {(r.doc_id, r.license): (r.n_units, r.whole) for r in licenses.scan(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    assert out == {(i, name): (2 if i == 203 else 1, i < 100 or i in (200, 202)) for i, name, _ in rows if name}
    stated = ["Copyright (c) 2020 A", "copyright 1999 b", "© A", "Copyright The Authors", "(c) 2001 A", "All rights reserved."]
    prose = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "(c) You must retain", "copyrighted work"]
    lines = spark.createDataFrame([(x,) for x in stated + prose], "t string").select("t", licenses.normalised(F.col("t")).alias("n")).collect()
    assert [r.t for r in lines if not r.n] == stated


def test_licences_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    theirs = con.execute(licenses.ORACLE_SQL).fetchall()
    ours = [(r.doc_id, r.license, r.n_units, r.whole) for r in licenses.op6_license_scan(spark, SF).collect()]
    assert sorted(ours) == sorted(theirs) and ours
