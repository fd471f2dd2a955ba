"""Training-data operators against brute-force versions on small tables.

Each fixture holds null, empty and very long texts, ties, repeated rows and
columns whose names clash with internal ones.
"""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key string, g int, _text string, score double, h string"


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text), with clashing extra columns."""
    return spark.createDataFrame([(i, t, "k", 1, "x", 0.5, None) for i, t in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 90])))) for i in range(40)]
    base = [w + str(k) for k, w in enumerate(words)]
    for i in range(40, 80):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(60)] = "edit" + str(rng.randrange(9))
        out.append((i, "\t ".join(w)))
    out += [(100, None), (101, ""), (102, " \n"), (103, "Zürich 𝒳 é́"), (104, "long " * 20000 + "end")]
    return out


def test_substring_dedup(spark, rows):
    from quarry.llm.substring_dedup import remove_repeats

    rows = [*rows, rows[50], (None, rows[50][1])]
    for width in (1, 6, 35):
        seen = collections.Counter()
        split = [WORD.findall(t or "") for _, t in rows]
        for w in split:
            seen.update(tuple(w[j: j + width]) for j in range(len(w) - width + 1))
        want = []
        for (i, _), w in zip(rows, split):
            gone = [False] * len(w)
            for j in range(len(w) - width + 1):
                if seen[tuple(w[j: j + width])] > 1:
                    gone[j: j + width] = [True] * width
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        got = [tuple(r) for r in remove_repeats(frame(spark, rows), width).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert remove_repeats(frame(spark, []), 35).count() == 0


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_minhash(spark, rows):
    from quarry.llm.minhash import near_duplicates

    for width, percent in ((3, 85), (5, 80)):
        sets = {i: shingles(t, width) for i, t in rows}
        links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        comp = groups(sets, links)
        want = sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in sets)
        got = near_duplicates(frame(spark, [*rows, rows[60], (None, rows[60][1])]), width, percent).collect()
        assert sorted({tuple(r) for r in got if r[0] is not None}) == want
        assert [(r[2], r[3]) for r in got if r[0] is None] == [(None, True)]


def test_components_of_long_chains(spark):
    from quarry.llm.components import connected_components

    links = [(i, i + 1) for i in range(0, 40)] + [(100 + (i * 7) % 23, 100 + ((i + 1) * 7) % 23) for i in range(22)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 123), 100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bpe_round_trip(spark, rows):
    from tokenizers import Tokenizer

    from quarry.llm.bpe import encode_documents, vocabulary_path

    path = vocabulary_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*rows, (200, "don't  <|endoftext|>x \u0085 日本 🎉 \x00"), (None, "a")]
    got = {r["doc_id"]: r for r in encode_documents(frame(spark, rows), path, ids=True).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_token_ids(spark, rows, tmp_folder):
    from tokenizers import Tokenizer

    from quarry.llm.bpe import vocabulary_path
    from quarry.llm.token_ids import read_token_ids, write_token_ids

    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*rows, (200, "It'S <|endoftext|> É̀ x\x01y"), (-5, "minus")]
    write_token_ids(frame(spark, rows), path, f"{tmp_folder}/ids", 2)
    got, at = sorted(tuple(r) for r in read_token_ids(spark, f"{tmp_folder}/ids").collect()), 0
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert r == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    write_token_ids(frame(spark, []), path, f"{tmp_folder}/none", 2)
    assert read_token_ids(spark, f"{tmp_folder}/none").count() == 0


def test_elias_fano():
    from quarry.llm.elias_fano import EliasFano, encode

    rng = np.random.Generator(np.random.PCG64(1))
    for n, top in ((0, 5), (1, 1), (3, 10 ** 12), (1000, 7), (50_000, 10 ** 9)):
        v = np.sort(rng.integers(0, top, n))
        coded = EliasFano(encode(v))
        assert (coded.values() == v).all()
        assert all(coded.select(i) == v[i] for i in range(0, n, 97))


def test_language_model(spark, rows):
    from quarry.llm.ngram_lm import ALPHA, lm_scores

    end, uni, pair, split = object(), collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(LOWER)), end]
        split[i] = w
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(w)
            pair.update(zip([end, *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    one = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    for r in lm_scores(frame(spark, rows)).collect():
        w = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0, len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(one(x)) for x in w), rel_tol=1e-9)
        exact = sum(math.log10(pair[a, b] / (uni[a] + ALPHA) + ALPHA / (uni[a] + ALPHA) * one(b)) for a, b in zip([end, *w[:-1]], w))
        assert abs(r["score"] - exact) <= 0.02 * len(w)  # a byte of quantisation
    assert lm_scores(frame(spark, [])).count() == 0


def test_language_model_of_three_words(spark, tmp_path):
    from quarry.llm import ngram_lm
    from quarry.llm.ngram_lm import ALPHA

    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(1000 + i, "x a y") for i in range(60)] + [(2000 + i, "z a v") for i in range(60)]  # what follows a is told by the word before it
    rows += [(3000, None), (3001, ""), (None, "x a v"), (3002, "z a y"), (1001, "x a y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    end, grams, held = object(), [collections.Counter() for _ in range(4)], collections.Counter()
    tokens = lambda t: [end, end, *(t or "").split(), end]
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = tokens(t)
            for k in range(2, len(w)):
                for n in (1, 2, 3):
                    grams[n][tuple(w[k - n + 1: k + 1])] += 1
                held[tuple(w[k - 2: k])] += 1  # as a context
    n, v = sum(grams[1].values()), len(grams[1])

    def log_p(a, b, c):
        p = (grams[1][c,] + 0.1) / (n + 0.1 * (v + 1))
        p = (grams[2][b, c] + ALPHA * p) / (grams[1][b,] + ALPHA)
        return math.log10((grams[3][a, b, c] + ALPHA * p) / (held[a, b] + ALPHA))
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_lm.op9_ngram_lm(spark, str(tmp_path)).collect()}
    for i, t in rows:
        w = tokens(t)
        want = sum(log_p(*w[k - 2: k + 1]) for k in range(2, len(w)))
        assert abs(got[i, len(w) - 2]["score"] - want) <= 0.005 * len(w)
    assert got[1000, 4]["score"] > got[3002, 4]["score"] + 0.3 and got[2000, 4]["score"] > got[None, 4]["score"] + 0.3
    documents = frame(spark, rows)
    assert ngram_lm.lm_scores(documents, order=4).count() == len(rows) and ngram_lm.lm_scores(documents.limit(0), order=3).count() == 0


def test_trie():
    from quarry.llm.elias_fano import EliasFano, encode
    from quarry.llm.ngram_lm import Trie, _counts

    rng = np.random.Generator(np.random.PCG64(3))
    for n, top in ((0, 5), (1, 1), (1, 1 << 61), (2000, 2100), (20_000, 10 ** 9)):
        v = np.unique(rng.integers(0, top, n))
        coded, ask = EliasFano(encode(v)), np.concatenate([v, rng.integers(0, top + 10, 500)])
        assert (coded.at(np.arange(len(v))) == v).all()
        assert (coded.find(ask) == [{x: k for k, x in enumerate(v.tolist())}.get(x, -1) for x in ask.tolist()]).all()
        assert (coded.find(v, np.arange(len(v)), np.arange(len(v)) + 1) == np.arange(len(v))).all() and (coded.find(v, np.arange(len(v)) + 1) == -1).all()
    held = collections.Counter(map(tuple, rng.zipf(1.4, (5000, 3)).clip(max=300).tolist()))  # (context, word, word before)
    asked = sorted({*held, *map(tuple, rng.integers(1, 320, (2000, 3)).tolist())})
    contexts, pairs = sorted({x[0] for x in asked}), sorted({x[:2] for x in asked})
    up = [np.array([contexts.index(x[0]) for x in pairs]), np.array([pairs.index(x[:2]) for x in asked])]
    word = [np.array([x[1] for x in pairs]), np.array([x[2] for x in asked])]
    trie = Trie(Trie.build(np.array(contexts), up, word, np.array([held[x] for x in asked])))
    two = collections.Counter()
    for x, k in held.items():
        two[x[:2]] += k
    for codes, want, (*_, step, _) in zip(trie.lookup(np.array(contexts), up, word), ([two[x] for x in pairs], [held[x] for x in asked]), trie.levels):
        assert np.allclose(_counts(step)[codes], want, rtol=0.03, atol=0) and ((np.array(want) == 0) == (codes == 0)).all()
    empty = Trie(Trie.build(np.array(contexts), up, word, np.zeros(len(asked))))
    assert not any(x.any() for x in empty.lookup(np.array(contexts), up, word))


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    from quarry.llm.pii import describe, find_pii, redact

    rng = random.Random(2)
    bits = ["a", "@", ".", "1", "2", "-", " ", "+", "(", ")", "é", "😀", "b.c", "1.2.3.4", "4111 1111 1111 1111", "x@y.z", "%", "256", "00"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(50)))) for i in range(500)]
    rows += [(900, "a@b.c" * 300), (901, "a." * 5000), (902, "9 " * 20000), (903, "x" * 200000), (904, None), (905, ""), (None, "a@b.cd")]
    rows += [(1000 + k, f'😀 password="{hashlib.md5(str(k).encode()).hexdigest()}" end') for k in range(20)]
    found = find_pii(frame(spark, rows))
    got = {r["doc_id"]: r for r in describe(found).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = ",".join(s for s in got[i]["spans"].split(",") if s and not s.startswith("secret"))
        assert own == base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
    assert all(got[1000 + k]["spans"] == "secret:12:44" for k in range(20))
    assert not any(got[i]["n_secret"] for i in range(500))
    texts = {r["doc_id"]: r["t"] for r in found.select("doc_id", redact(found).alias("t")).collect()}
    assert texts[1000] == '😀 password="<SECRET>" end' and texts[None] == "<EMAIL>" and texts[904] is None


def test_toxicity(spark):
    from quarry.llm.toxicity import fit, score

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = [rng.choice(words) for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = w[rng.randrange(30)] = rng.choice(["vileone", "viletwo"])
        rows.append((i, " ".join(w)))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    rows += [(900, None), (901, ""), (None, "vileone viletwo")]
    label_rows = spark.createDataFrame([*labels, labels[0], (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in score(docs, fit(docs, label_rows)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"]


def test_decontamination(spark):
    from quarry.llm.decontaminate import Index, contaminated_items, normalise

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh  ") for _ in range(n))
    items = [(i, text(rng.choice([30, 60, 100, 150]))) for i in range(10)]

    def least_edits(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j - 1] + (t[j - 1] != c), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)
    index, rows, want = Index([(i, normalise(t)) for i, t in items]), [], {}
    for k in range(20):
        p = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(p))
            p[at: at + 1] = rng.choice([[], [rng.choice("xyz")], [p[at], "q"]])
        rows.append((k, text(40) + "".join(p).upper() + "\n\n" + text(30)))
        want[k] = sorted({index.items[j] for j, q in enumerate(index.patterns) if least_edits(q, normalise(rows[-1][1])) <= index.edits[j]})
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, "zz " * 50000 + items[1][1])]
    want |= {100: [], 101: [], None: [0], 102: [1]}
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "short"), (None, "x" * 50)], "item_id long, text string")
    got = {r["doc_id"]: r["_items"] for r in contaminated_items(frame(spark, rows), bench).collect()}
    assert got == want


def test_decontamination_of_clipped_and_edited_passages(spark):
    from quarry.llm.decontaminate import contaminated_items

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))[:n].strip()
    items = {i: text(n) for i, n in enumerate((118, 200, 240, 300, 394))}
    clipped = {0: [(0, 112), (6, 118)], 1: [(0, 189), (60, 160)], 2: [(13, 240), (31, 130)], 3: [(0, 222), (47, 269)], 4: [(100, 322), (295, 394)]}
    rows, want = [], {}
    for i, cuts in clipped.items():
        rows += [(len(rows) + k, f"{text(50)} {items[i][a:b]} {text(50)}") for k, (a, b) in enumerate(cuts)]
        want |= {r[0]: [i] for r in rows[-len(cuts):]}
    for i in range(1, 5):  # one word in ten replaced
        want[len(rows)] = [i]
        rows.append((len(rows), f"{text(50)} {' '.join('zzzzz' if k % 10 == 5 else w for k, w in enumerate(items[i].split()))} {text(50)}"))
    rows += [(100, text(2000)), (101, items[4][:60])]
    want |= {100: [], 101: []}
    got = contaminated_items(frame(spark, rows), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {r["doc_id"]: r["_items"] for r in got} == want


def test_pages(spark):
    from quarry.llm.html_text import common_lines, extract_text

    page = lambda body: f"<html><head><title>t</title><script>if (a<b) '<p>'</script></head><body><nav><a>Home</a></nav>{body}<footer>f</footer></body>"
    rows = [(1, "http://h.x/a/1", page("<div>Shared line</div><div>One &amp two&nbsp;&#233;</div>")), (2, "http://h.x/a/2", page("<div>Shared line</div><div>Other</div>")),
            (3, "http://h.x/b/3", page("<article><h1>T</h1><p>Shared line<p>x <b>y</b>z<br>w<div class='comments'>no</div><aside>no</aside></article>")),
            (4, None, "<p>a</p><!-- no --><form>no</form>b"), (5, "http://i.x/", None), (6, "nonsense", ""), (7, "http://h.x/c", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in extract_text(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, path int")).collect()}
    assert got[1]["text"] == "One & two é" and got[2]["text"] == "Other"
    assert got[3]["text"] == "T\n\nShared line\n\nx yz\n\nw"
    assert got[4]["text"] == "a\n\nb" and got[5]["text"] == "" == got[6]["text"] and got[7]["n_chars"] == 4

    def longest(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert len(common_lines(a, b)) == longest(a, b)


def test_pages_at_partition_edges(spark, monkeypatch):
    from quarry.llm import html_text

    page = lambda k, h: f"<div>Menu of {h}</div><div>Text {k} of {h}</div><div>Imprint of {h}</div>"
    rows = [(k, f"http://{h}.x/{k:03}", page(k, h)) for k, h in enumerate("a" * 10 + "b" + "c" * 10)]
    rows += [(100 + k, f"http://c.x/copy{k}", page("copied", "c")) for k in range(6)] + [(200, "http://c.x/d", page("last", "c"))]
    lines = {i: re.findall("<div>(.*?)</div>", p) for i, _, p in rows}
    want = {i: "\n\n".join(x) if i == 10 else x[1] for i, x in lines.items()}  # page 10 is alone on its host
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 200, 60, 20):  # one partition, some, about one page each, more partitions than pages
        monkeypatch.setattr(html_text, "PARTITION_BYTES", size)
        assert {r["page_id"]: r["text"] for r in html_text.extract_text(frame_).collect()} == want


def test_near_copied_pages_keep_their_text(spark, monkeypatch):
    from quarry.llm import html_text

    div = lambda *x: "".join(f"<div>{t}</div>" for t in x)
    body = lambda k: [f"Paragraph {j} of text {k} " + "tells something new " * 4 + f"{k}." for j in range(6)]
    menu = [f"Entry {j}" for j in range(20)]
    rows, want = [], {}

    def add(host, name, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}.x/{name}", div(*menu, *text, "Imprint")))
    for k in range(5):
        add("a", f"a{k}", body(k))
    for k in range(12):  # near copies: one line differs
        add("a", f"m{k:02}", [f"Date {k}", *body("m")])
    for k in range(5):
        add("a", f"z{k}", body(10 + k))
    for k in range(12):  # nothing but near copies on a host
        add("b", f"{k:02}", [f"Date {k}", *body("b")])
        want[len(rows) - 1] = [*menu, *want[len(rows) - 1], "Imprint"]
    want = {i: "\n\n".join(t.strip() for t in x) for i, x in want.items()}
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 3000, 1000):
        monkeypatch.setattr(html_text, "PARTITION_BYTES", size)
        assert {r["page_id"]: r["text"] for r in html_text.extract_text(frame_).collect()} == want


def test_embeddings(spark):
    from quarry.llm.embedding_dedup import embedding_duplicates

    rng = np.random.Generator(np.random.PCG64(5))
    base = np.repeat(rng.standard_normal((60, 16)), 5, axis=0)
    x = base + 0.1 * rng.standard_normal(base.shape)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(500 + i, x[0].tolist(), 0) for i in range(20)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] * 16, 0), (604, x[0].tolist(), None), (605, [1.0], 0)]
    ok = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if i < 600]
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and a[1] @ b[1] >= 0.98]
    comp, n = groups([r[0] for r in rows], links), collections.Counter(i for p in links for i in p)
    want = sorted((i, n[i], comp[i], comp[i] == i) for i in comp)
    frame_ = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "vec_id long, embedding array<double>, label int, x double, key string")
    assert sorted(tuple(r) for r in embedding_duplicates(frame_).collect()) == want
    assert embedding_duplicates(frame_.limit(0)).count() == 0


def test_embeddings_in_several_shards(spark, monkeypatch, caplog):
    from quarry.llm import embedding_dedup as e

    monkeypatch.setattr(e, "SHARD", 100)
    rng = np.random.Generator(np.random.PCG64(6))
    x = np.repeat(rng.standard_normal((150, 16)), 2, axis=0)
    x[1::2] += 0.1 * rng.standard_normal((150, 16))
    x = np.concatenate([x, rng.standard_normal((300, 16))])
    rows = [(i, v.tolist(), int(i >= 300)) for i, v in enumerate(x)]  # label 1 has no links
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a, b in itertools.combinations(range(600), 2) if (a < 300) == (b < 300) and unit[a] @ unit[b] >= 0.98]
    assert links and all(b < 300 for _, b in links)
    comp, n = groups(range(600), links), collections.Counter(i for p in links for i in p)
    with caplog.at_level("INFO", e.__name__):
        got = sorted(tuple(r) for r in e.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted((i, n[i], comp[i], comp[i] == i) for i in comp)
    assert [m for m in caplog.messages if m.startswith("beam")][-1].endswith(" 0 labels again")
    # a vector's own row is no link, a missed link counts, and no link at all asks for no wider beam
    two = unit[[links[0][0], links[0][1], 400]]
    assert e._audit(two, two, True, np.array([1]), 0.98) == (1, 1) and e._audit(two, two, True, np.zeros(0, int), 0.98) == (0, 1)
    assert e._audit(unit[300:400], unit[400:], False, np.zeros(0, int), 0.98) == (0, 0)
    assert not [m for m in caplog.messages if m.startswith("beam 128")]


def test_embeddings_in_cells(spark, monkeypatch):
    from quarry.llm import embedding_dedup as e

    monkeypatch.setattr(e, "SHARD", 80)
    monkeypatch.setattr(e, "BLOCK", 300)
    rng = np.random.Generator(np.random.PCG64(8))
    centres = np.eye(8)[:6]
    x = [centres[k % 6] + 0.05 * rng.standard_normal(8) for k in range(420)]  # far apart: no shard need be searched by another's vectors
    dense = np.ones(8) + 0.03 * rng.standard_normal((300, 8))  # more links than a beam, and one cell that is cut into parts
    spread = rng.standard_normal((500, 8))  # cells that meet everywhere
    vectors = [*((v, 0) for v in x), *((v, 1) for v in dense), *((v, 1) for v in rng.standard_normal((40, 8))), *((v, 2) for v in spread),
               *((v + 0.05 * rng.standard_normal(8), 2) for v in spread)]
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(vectors)]
    unit = np.array([v / np.linalg.norm(v) for v, _ in vectors])
    label = np.array([c for _, c in vectors])
    links = [(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.98)) if a < b and label[a] == label[b]]
    comp, n = groups(range(len(rows)), links), collections.Counter(i for p in links for i in p)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in e.embedding_duplicates(vectors).collect()) == sorted((i, n[i], comp[i], comp[i] == i) for i in comp)
    classes = spark.createDataFrame([(str(c), i, 1, unit[i].tolist()) for i, c in enumerate(label.tolist()) if c == 0], "label string, rep long, copies long, unit array<double>")
    shards, asked = e._shards(classes, 0.98)
    shards = shards.select("x", "links").collect()
    assert len(shards) >= 5 and asked.count() < 420 * (len(shards) - 1) / 4  # a graph a shard; all pairs of shards: twice as many
    for r in shards:
        part = np.frombuffer(r["x"]).reshape(-1, 8)
        assert all((a == b).all() for a, b in zip(e.Graph(part).links, e.Graph(part, r["links"]).links))


def test_links_of_a_graph():
    from quarry.llm import embedding_dedup as e

    rng = np.random.Generator(np.random.PCG64(9))
    x = np.concatenate([rng.standard_normal((1500, 32)), np.ones(32) + 0.05 * rng.standard_normal((300, 32))])
    x = np.concatenate([x, x[:300] + 0.08 * rng.standard_normal((300, 32))])[rng.permutation(2100)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    want, graph = x @ x.T >= 0.98, e.Graph(x)
    for own in (True, False):
        got = e._links(graph, x, 0.98, 64, own)
        assert not (got & ~want).any() and (got & want).sum() >= 0.999 * want.sum()
    assert (e._links(graph, x, 0.98, 4096) == want).all()


def test_pipeline_stages(spark, rows):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in [*rows, rows[0], (None, "x y"), (300, "mail a@b.cd now")]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    one = pipeline.drop_near_duplicates(spark, docs, "")
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = groups(sets, links)
    assert one.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in one.collect()))) == sorted([*(str(i) for i in comp if comp[i] == i), "None", "300"])
    clean = {r["doc_id"]: r for r in pipeline.redact_personal_data(spark, docs, "").where(F.col("doc_id") == 300).collect()}
    assert clean[300]["text"] == "mail <EMAIL> now" and clean[300]["n_chars"] == 16
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]


def test_token_ids_of_new_chunks():
    """New chunks of plain characters share their words' ids; all ids are the tokenizer's."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from quarry.llm.token_ids import ChunkEncoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = ChunkEncoder(f.read())
    texts = ["Été, été. «été» ÉTÉ!", "Don't I'LL d'été it’S", "1é2 É\x01é é\x7f\x05 a\x1cb", "ñ́ é ×÷ª ÿŸ İK 🙂x b　c d\x85e", "<| Ça<|x|> <|endoftext|>", "", " \n"]
    assert encoder.encode([texts[0].encode()], 2) and {"été", ",", ".", "«", "»", "!"} == set(encoder.parts.recent)
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts], 2)):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, encoder.kind).tolist() == [*want, 2], text
