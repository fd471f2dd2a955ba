"""Pages that are copies of every page an edge hands on are decided all the same."""


def test_a_copy_of_all_pages_of_an_edge(spark, monkeypatch):
    from quarry.llm import html_text
    long = ["".join(chr(97 + (i * 7 + k * (i + 3)) % 26) for k in range(200)) for i in range(41)]
    same, rare = "a line of 25 code points.", "a rare"
    pages = [(0, "https://h/000", f"<p>{rare}</p><p>{long[0]}</p>")]
    pages += [(i, f"https://h/{i:03d}", f"<p>{same}</p><p>{i} {long[i]}</p>") for i in range(1, 41)]
    pages.append((41, "https://h/041", f"<p>{same}</p><p>{rare}</p>"))  # a copy of all but the first, whose line it shares
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {0: f"{rare}\n\n{long[0]}"} | {i: f"{i} {long[i]}" for i in range(1, 41)} | {41: same}
    for size in (1 << 20, 600):
        monkeypatch.setattr(html_text, "PARTITION_BYTES", size)
        assert {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()} == want


def test_finished_texts_are_kept_in_blocks(spark, monkeypatch):
    """Between the passes the texts of many pages are compressed together, several blocks a partition if they are long."""
    import random
    import zlib

    from quarry.llm import html_text
    rng, kept, cut = random.Random(5), [], html_text.cut
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    texts = {i: " ".join(rng.choices(words, k=120)) for i in range(300)}
    frame = spark.createDataFrame([(i, f"https://h{i % 3}/{i:04d}", f"<nav>menu</nav><p>{t}</p>") for i, t in texts.items()] + [(300, None, None)],
                                  "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "BLOCK_CHARS", 50_000)
    monkeypatch.setattr(html_text, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(frame).collect()}
    assert got == {i: (t, len(t)) for i, t in texts.items()} | {300: ("", 0)}
    blocks = [r["texts"] for r in kept[0].where("texts is not null").select("texts").collect()]
    assert len(blocks) == 5 and sum(map(len, blocks)) < 0.85 * sum(len(zlib.compress(t.encode(), 1)) for t in texts.values())
