"""Repeated lines, main bodies and splitting."""

import re
from random import Random

import pytest

from larkspur.llm import body, lines, split

PAGE = "page_id long, final_url string, title string, raw_text string, line int, site string"


def host(url):
    m = re.match(r"(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", (url or "").strip().lower())
    return re.sub(r"^www\.", "", m[1]) if m else ""


def brute_lines(rows):
    pages, stands, where = {}, {}, []
    for i, u, _, t, *_ in set(rows):
        h = host(u)
        if i is None or not t or not h:
            continue
        pages.setdefault(h, set()).add(i)
        for n, raw in enumerate(t.split("\n"), 1):
            plain = " ".join(raw.casefold().split())
            if sum(c.isalpha() for c in plain) >= 3:
                stands.setdefault((h, plain), set()).add(i)
                where.append((h, plain, i, n))
    return {(i, n) for h, p, i, n in where if len(stands[h, p]) >= 6 and 4 * len(stands[h, p]) >= len(pages[h])}


def test_repeated_lines_match_brute_force(spark):
    r = Random(3)
    common = ["Accept all", "ACCEPT  ALL", " accept all ", "Share this page", "Straße frei", "STRASSE FREI", "12 34", "ab", "中文字 here"]
    urls = ["https://www.Big.example:8080/a", "http://big.example/b", "https://u@small.example", "https://few.example/", None, "nonsense"]
    rows = []
    for k in range(120):
        text = r.choice(["\n", "\r\n"]).join(r.choice(common) if r.random() < 0.5 else f"own line {r.randint(0, 10**6)}" for _ in range(r.randint(0, 6)))
        rows.append((k, r.choice(urls[:3]) if k < 100 else r.choice(urls), "t", r.choice([text, text, text, text, None, " "]), 1, "s"))
    rows += rows[:10] + [(None, urls[0], "t", "Accept all", 1, "s")]
    df = spark.createDataFrame(rows, PAGE)
    got = lines.repeated_lines(df).collect()
    assert {(x.page_id, x.line_no) for x in got} == brute_lines(rows) and got
    kept = {x.page_id: x.kept_text for x in lines.without_lines(df, lines.repeated_lines(df)).collect()}
    gone = brute_lines(rows)
    for i, _, _, t, *_ in rows:
        if i is not None:
            want = t if t is None or not any(p == i for p, _ in gone) else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone)
            assert kept[i] == want
    assert lines.repeated_lines(df.where("false")).count() == 0


def article(n, site="Some Site"):
    k = "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in str(n + 100))
    return [f"Cookies on {site} please", "", "Home | About | Help", "", f"# On subject number {k.title()}", f"By {site} Staff", "", f"The body of article {k} is a long enough sentence about subject {k} and nothing else.", "", "## Limits", f"Another paragraph {k} that no other page has, with words of its own.", "", "Also here", f"On subject number X{k}", f"- On subject number Y{k}", "", f"It ends here with the last sentence {k} of the article.", "", "Share this page", f"© 2020 {site}. All rights reserved."]


def test_main_body(spark):
    rows = [(k, "https://some-site.example/a", article(k)[4][2:], "\n".join(article(k)), 1, "s") for k in range(30)]
    rows += [(100, "https://some-site.example/b", None, None, 1, "s"), (101, "https://some-site.example/c", None, "", 1, "s"), (102, None, "Lone", "Lone\n\nOnly text here.", 1, "s"), (103, "https://x.example", "T", "\n" * 5, 1, "s")]
    df = spark.createDataFrame(rows + rows[:4], PAGE)
    got = {}
    for x in body.main_body(df).collect():
        got.setdefault(x.page_id, set()).add(x.line_no)
    for k in range(30):
        assert got[k] == {5, 8, 10, 11, 17}, got[k]
    assert got[102] == {1, 3} and not {100, 101, 103} & set(got)
    assert body.main_body(df.where("false")).count() == 0


def test_layout_keeps_code_and_tables():
    text = "menu\n\n# T\n\n```\nabc\n```\n\n| a | b |\n|---|---|\n\nfoot"
    assert body.body_lines(text, "T", "", {1, 12}, set()) == [3, 5, 6, 7, 9, 10]


@pytest.mark.parametrize("limit, overlap", [(100, 20), (64, 31), (800, 150), (5, 2)])
def test_pieces_fit_and_rebuild(limit, overlap):
    r = Random(limit)
    for kind in ("ab c.\n", "a", "中文。 ", "x\n\n"):
        text = "".join(r.choice(kind) for _ in range(limit * 7 + 3))
        cuts = split.cut_places(text, limit, overlap)
        assert all(0 < e - s <= limit for s, e in cuts)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        for (_, e1), (s2, e2) in zip(cuts, cuts[1:], strict=False):
            assert 0 <= e1 - s2 <= overlap and e2 > e1
        rebuilt = text[: cuts[0][1]] + "".join(text[e1:e2] for (_, e1), (_, e2) in zip(cuts, cuts[1:], strict=False))
        assert rebuilt == text


def test_cuts_prefer_paragraphs_and_survive_edits():
    r = Random(1)
    text = "\n\n".join(" ".join(f"w{r.randint(0, 999)}" for _ in range(20)) + "." for _ in range(200))
    cuts = split.cut_places(text, 800, 150)
    assert all(text[:e].endswith("\n\n") for _, e in cuts[:-1])
    edited = text[:3000] + "inserted words " + text[3000:]
    ends, shifted = {e for _, e in cuts}, {e - 15 for _, e in split.cut_places(edited, 800, 150)}
    late = [e for e in ends if e > 8000]
    assert len([e for e in late if e in shifted]) >= 0.9 * len(late)


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "word " * 100, 1), (2, "x" * 80, 1), (3, None, 1), (None, "y" * 500, 1), (1, "word " * 100, 1)], "id long, text string, limit int")
    rows = split.split_oversized([("t", df, "id", "text", 80, 10)]).collect()
    assert {r.item_id for r in rows} == {1} and len(rows) == len({r.piece_no for r in rows})
    assert all(r.piece == ("word " * 100)[r.start : r.end] for r in rows)
    assert split.split_oversized([("t", df.where("false"), "id", "text", 80, 10)]).count() == 0


def test_masks():
    assert body.site_names("docs.harbour-desk.example") == ["harbour desk"] and body.site_names("the-lag.example") == ["the lag", "lag"]


def test_a_long_notice_on_many_pages_goes_and_a_copied_passage_stays(spark):
    notice = "We and our partners keep and read details on your device to show what may matter to you, " * 3
    passage = "The river rose by a metre in the night and the lower fields were under water until noon, said the warden of the lock. " * 2
    rows = [(k, f"https://a.example/{k}", f"Story number {k} of the day", f"Story number {k} of the day\n\nOnly page {k} says this sentence about topic {k * 7}.\n\n{passage if k < 3 else f'A paragraph of page {k} with words of its own.'}\n\n{notice}") for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, final_url string, title string, raw_text string")
    kept = {}
    for r in body.main_body(df).collect():
        kept.setdefault(r.page_id, set()).add(r.line_no)
    assert all(7 not in lines for lines in kept.values()) and all(5 in kept[k] for k in range(3))


@pytest.mark.parametrize("rows", [1, 3, 50, 10_000])
def test_runs_of_sorted_suffixes_count_pages(rows):
    import pyarrow as pa

    r = Random(rows)
    data = sorted((r.choice(["a", "b"]), r.randint(0, 3), r.randint(0, 1), r.random() < 0.2, r.randint(0, 12)) for _ in range(400))
    want = {}
    for *key, page in data:
        want.setdefault(tuple(key), set()).add(page)
    names = [*body.RUN, "page_id"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in data[k : k + rows]], schema=pa.schema([("site", pa.string()), ("prefix", pa.int64()), ("template", pa.int64()), ("long", pa.bool_()), ("page_id", pa.int64())])) for k in range(0, len(data), rows)]
    got = {}
    for b in body._runs(iter(batches)):
        for x in b.to_pylist():
            key = tuple(x[c] for c in body.RUN)
            got[key] = got.get(key, 0) + x["pages"]
    assert got == {k: len(v) for k, v in want.items()}
