"""Private items: shapes, learned patterns and decoys."""

from larkspur.llm import pii

GIVEN, FAMILY = [f"Gi{a}{b}" for a in "abcde" for b in ("mo", "la")], [f"Fam{a}{b}" for a in "abcde" for b in ("sten", "vic")]


def corpus():
    texts = []
    for k in range(200):
        g, f = GIVEN[k % 10].capitalize(), FAMILY[(k * 7 + k // 10) % 10].capitalize()
        texts += [f"Landlord is {g} {f}.", f"Please note that {g} {f} can be reached at +1 555 555 {1000 + k}.", f"User's sister {g} {f} lives at {k + 1} Heron Road.", f"User calls the {g} Cluster project Bodo."]
        texts += [f"Form: ssn: 9{k:02d}-55-{1000 + k}", f"Ref 900-{1000 + k}-{10000 + k} was only a parts order.", f"I keep ssn 9{k:02d}-55-{2000 + k} safe", f"User's sister {g} {f} lives at Am Wehr {k + 1}."]
    return texts


def found(spark, extra):
    texts = corpus() + extra
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a@b.example"), (9999, None), (9998, " ")]
    memories = spark.createDataFrame(rows + rows[:3], "record_id long, text string")
    cases = spark.createDataFrame([("c1", [("user", None), ("tool", "mail x.y+z@sub.example.org now")]), ("c2", None)], "case_id string, conversation array<struct<role:string,content:string>>")
    # half of the parts are unknown at first
    parts = spark.createDataFrame([(g, "given") for g in GIVEN[:6]] + [(f, "family") for f in FAMILY[:6]] + [(None, None)], "name_part string, part_kind string")
    out = {}
    for r in pii.found_items(memories, cases, parts).collect():
        out.setdefault(r.row_key, set()).add((r.kind, r.found_text))
    base = len(corpus())
    return out, [out.get(str(base + k), set()) for k in range(len(extra))]


def test_items(spark):
    extra = [
        f"call {GIVEN[8].upper()} {FAMILY[9].upper()} soon",
        f"{FAMILY[7]}, {GIVEN[2]} Q. came",
        f"{GIVEN[1]} T. {FAMILY[8]}-{FAMILY[0]} signed",
        "Write to jo.doe at mail dot example dot net please",
        "jo+x [at] example [dot] com",
        "Pinned the loader to Bodo@3.41.3 for now",
        "Call me: +1 555 555 0199, not 900-2222-33333",
        "it is 12 heron road, flat 2",
        "See am wehr 5 again",
        f"Only {GIVEN[0]} came",
        "",
    ]
    out, got = found(spark, extra)
    assert got[0] == {("name", f"{GIVEN[8].upper()} {FAMILY[9].upper()}")}
    assert got[1] == {("name", f"{FAMILY[7]}, {GIVEN[2]} Q.")}
    assert got[2] == {("name", f"{GIVEN[1]} T. {FAMILY[8]}-{FAMILY[0]}")}
    assert got[3] == {("email", "jo.doe at mail dot example dot net")}
    assert got[4] == {("email", "jo+x [at] example [dot] com")}
    assert got[5] == set()
    assert got[6] == {("phone", "+1 555 555 0199")}
    assert got[7] == {("address", "12 heron road, flat 2")}
    assert got[8] == {("address", "am wehr 5")}
    assert got[9] == set() and got[10] == set()
    assert out["c1"] == {("email", "x.y+z@sub.example.org")}
    assert not any("Cluster" in t for items in out.values() for _, t in items)
    kinds = {t: k for items in out.values() for k, t in items}
    assert kinds["900-55-2000"] == "identity" and not any(t.startswith("900-1") for t in kinds)


def test_redaction_and_empty(spark):
    memories = spark.createDataFrame([(1, "mail a@b.example or c@d.example!"), (2, "nothing")], "record_id long, text string")
    cases = spark.createDataFrame([], "case_id string, conversation array<struct<role:string,content:string>>")
    parts = spark.createDataFrame([], "name_part string, part_kind string")
    got = {r.row_key: r.redacted for r in pii.redacted_texts(memories, cases, parts).collect()}
    assert got == {"1": "mail [EMAIL] or [EMAIL]!", "2": "nothing"}
    assert pii.found_items(memories.where("false"), cases, parts).count() == 0


def test_a_full_sieve_loses_no_name(spark, monkeypatch):
    """A sieve that lets every word pass only makes more work: the joins decide."""
    extra = [f"call {GIVEN[8].upper()} {FAMILY[9].lower()} soon", "call some other one soon"]
    few = found(spark, extra)[0]
    monkeypatch.setattr(pii, "sieve_of", lambda parts: b"\xff" * (pii.SIEVE // 8))
    assert found(spark, extra)[0] == few and few[str(len(corpus()))] == {("name", f"{GIVEN[8].upper()} {FAMILY[9].lower()}")}
