"""Personal information in free text by bootstrapped contextual extraction.

Tasks pull loose candidates out of the texts: number-like runs, neighbouring words that may be a name, words with a
house number, addresses of mail. Few of them are known: numbers behind a telling word, words of the list of name parts,
streets with a street word, addresses with their signs. These seeds score the patterns they stand in (shape of the number, words before
and after), patterns score the other candidates in them, and so on for a few rounds; what stands in trusted patterns
becomes known: new name parts, new streets, numbers without a label. Scores are aggregates over distinct
(candidate, pattern) rows, joined by equality; texts and their candidates never leave the cluster.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import blank
from larkspur.session import keep

# Seed words. What stands just before a number tells what it is.
PHONE_WORDS = ["phone", "tel", "telefon", "teléfono", "téléphone", "mobile", "móvil", "mobil", "handy", "dial", "fax", "text", "call", "rückruf", "llamar"]
IDENTITY_WORDS = ["ssn", "security", "passport", "pass", "reisepass", "ausweis", "pasaporte", "passeport", "steuer", "tax", "national", "dni", "nif", "nie", "licence", "license", "führerschein", "permiso", "permis", "staff", "employee", "personalnummer"]
THING_WORDS = ["order", "ticket", "inc", "version", "port", "budget", "build", "commit", "run", "node", "serial", "machine", "product", "invoice", "seat", "tokens", "pages"]
STREET_ENDS = ["road", "rd", "street", "st", "avenue", "ave", "lane", "drive", "close", "court", "way", "place", "square", "terrace", "crescent", "boulevard", "blvd"]
STREET_STARTS = ["calle", "avenida", "plaza", "paseo", "camino", "carrera", "rue", "chemin", "avenue", "boulevard", "place", "allée", "impasse", "quai", "via"]
STREET_TAILS = ["straße", "strasse", "str", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer"]
PARTICLES = ["de", "del", "des", "du", "la", "las", "los", "le", "les", "el", "al", "der", "den", "dem", "di"]
UNIT_WORDS = ["unit", "flat", "apt", "apartment", "suite", "wohnung", "piso", "appartement", "room"]

_W = r"[^\W\d_]"
_UNIT = rf"(?:,\s*(?:{'|'.join(UNIT_WORDS)})\.?\s*\d+[a-z]?\b|,?\s+#\d+)?"
_TOKEN = re.compile(rf"{_W}+|\d+|[^\w\s]")
_EMAIL = re.compile(
    r"[^\W_][\w.+\-]*@[^\W_][\w\-]*(?:\.[\w\-]+)*\.[^\W\d_]{2,}(?![\w@])"
    r"|[^\W_][\w.+\-]*\s*(?:\[at\]|\(at\)|\{at\}|<at>)\s*[\w\-]+(?:\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\s*[^\W_][\w\-]*|\.[^\W_][\w\-]*|\s+dot\s+[^\W_][\w\-]*)+"
    r"|[^\W_][\w.+\-]*\s+at\s+[\w\-]+(?:\s+dot\s+[\w\-]+)+",
    re.I,
)
_WRITTEN_OUT = re.compile(r"[\[({<]at[\])}>]|\sdot\s", re.I)
_NUMBER = re.compile(r"(?<![\w@./\-:])(?:\+\s?|\()?(?:[A-Z] |[A-Za-z]{1,5}-?)?\d(?:[\d ()/.\-]*\d)?(?:[A-Za-z]\d{0,2})?(?![\w@]|[./\-]\d|:\d)")
_PAIR = re.compile(rf"(?<![\w@.+\-])(?=({_W}{{2,}}(?:-{_W}{{2,}})?)(?:[^\S\n]+{_W}\.)?(,?)[^\S\n]+({_W}{{2,}}(?:-{_W}{{2,}})?)((?:[^\S\n]+{_W}\.(?![\w]))?)(?![\w@+]|\.\w))")
_FIRST = re.compile(rf"(?<![\w./\-])(\d{{1,4}}[a-zA-Z]?)[^\S\n]+((?:{_W}[\w'’\-]*[^\S\n]+){{1,3}}?({'|'.join(STREET_ENDS)}))\b((?<=[Ss][Tt])\.|(?<=ST)\.)?{_UNIT}", re.I)
_STREET = rf"(?:(?:{'|'.join(STREET_STARTS)})[^\S\n]+(?:(?:{'|'.join(PARTICLES)})[^\S\n]+){{0,2}}{_W}[\w'’\-]*|{_W}[\w\-]*(?:{'|'.join(STREET_TAILS)})\.?|{_W}[\w'’\-]*[^\S\n]+{_W}[\w'’\-]*|{_W}[\w'’\-]+)"
_LAST = re.compile(rf"(?<![\w./\-])(?=({_STREET})(,?[^\S\n]+)(\d{{1,4}}[a-zA-Z]?)(?![\w.:/\-]*\w)({_UNIT}))", re.I)
_WORDS = re.compile(rf"{_W}{{2,}}")
_HOUSE = re.compile(r"[^\S\n]\d{1,4}[a-zA-Z]?(?![\w.:/\-]*\w)")  # without one no street ends in a number
_TYPED = re.compile(rf"(?:{'|'.join(STREET_STARTS)})\s|\S*(?:{'|'.join(STREET_TAILS)})\.?$", re.I)

SIEVE = 1 << 20  # bits of the sieve of known name parts that goes to the tasks, 128 KB
CANDIDATES = "origin string, row_key string, turn_no int, hint string, start int, end int, found string, a string, b string, shape string, left string, right string, n int"


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    before = [t.lower() if not t.isdigit() else "0" for t in _TOKEN.findall(text[max(0, start - 40) : start])]
    after = [t.lower() if not t.isdigit() else "0" for t in _TOKEN.findall(text[end : end + 24])]
    return " ".join(before[-2:]) or "^", after[0] if after else "$"


def _label(text: str, start: int) -> str:
    return " ".join(t.lower() for t in _TOKEN.findall(text[max(0, start - 40) : start])[-4:])


def _mails(text: str) -> list[re.Match]:
    return list(_EMAIL.finditer(text)) if "@" in text or _WRITTEN_OUT.search(text) else []


def candidates_in(text: str) -> list[tuple]:
    """[(hint, start, end, found, a, b, shape, left, right, n)] of one text. Names come in their usual letter case only;
    ``loose_names`` has the others."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for m in _mails(text):
        form = "signs" if re.search(r"@|[\[({<]", m.group()) or len(re.findall(r"(?i)\sdot\s", m.group())) > 1 else "words"
        out.append(("email", m.start(), m.end(), m.group(), None, None, form, *_around(text, m.start(), m.end()), 1))
        taken.append(m.span())
    free = lambda s, e: all(e <= x or s >= y for x, y in taken)
    for m in _NUMBER.finditer(text):
        found = m.group()
        if found.startswith("(") and ")" not in found:
            found = found[1:]
        start, end = m.end() - len(found), m.end()
        digits = sum(c.isdigit() for c in found)
        if (digits >= 6 or digits >= 5 and found[0].isalpha()) and free(start, end):
            shape = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "0", found))
            out.append(("number", start, end, found, _label(text, start), None, shape, *_around(text, start, end), 1))
    for start, end, name, kind, form in _places(text):
        if free(start, end):
            # places in loose letter case are only looked up among the streets, not learnt from
            out.append(("place", start, end, text[start:end], name, kind, form, *(("", "") if kind == "loose" else _around(text, start, end)), 1))
    for start, end, a, b, form, second, cased in _pairs(text, [m.start() for m in _WORDS.finditer(text) if m.group()[0].isupper()]):
        if cased and free(start, end):
            out.append(("name", start, end, text[start:end], a.lower(), b.lower(), form, *_around(text, start, end), second))
    return out


def _places(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, street, typed or cased or loose, form): words with a house number. The street has no English street
    word, which may be written in several ways."""
    for m in _FIRST.finditer(text):
        name = m.group(2).lower().removesuffix(m.group(3).lower())
        yield m.start(), m.end(), " ".join(name.split()), "typed" if all(w[0].isupper() for w in m.group(2).split()) else "loose", "first"
    for m in _LAST.finditer(text) if _HOUSE.search(text) else ():
        street = m.group(1)
        last_up = street.split()[-1][0].isupper()
        kind = ("typed" if last_up else "loose") if _TYPED.match(street) else "cased" if street[0].isupper() and last_up else "loose"
        yield m.start(1), m.end(4), " ".join(street.lower().rstrip(".").split()), kind, "last"


def _pairs(text: str, starts: list[int]) -> Iterator[tuple[int, int, str, str, str, int, bool]]:
    """(start, end, given, family, form, start of the second word, cased): neighbouring words, by their reading, whose first
    begins at one of the places."""
    for at in starts:
        m = _PAIR.match(text, at)
        if m is None:
            continue
        w1, comma, w2, tail = m.group(1), m.group(2), m.group(3), m.group(4)
        start, end, cased = m.start(1), m.end(3), w1[0].isupper() and w2[0].isupper()
        if not comma:
            yield start, end, w1, w2, "plain", m.start(3), cased
        elif text[m.end(1)] == ",":  # an initial before a comma belongs to no name
            yield start, m.end(4) if tail else end, w2, w1, "comma", m.start(3), cased


class _Sieve(dict):
    """Whether a word may be a known name part: always true of those that are, seldom of others."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        at = xxhash.xxh64_intdigest(word.encode(), seed=42) % SIEVE
        known = self[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return known


def loose_names(text: str, known: _Sieve) -> list[tuple]:
    """As ``candidates_in``, of names in unusual letter case. A pair is one if all its words may be known parts and one of
    them begins with a small letter; the joins that follow are exact. Words are looked up once, and only texts with a
    known part in a small letter are read further."""
    words = [(m.start(), m.group()) for m in _WORDS.finditer(text)]
    small = [k for k, (_, w) in enumerate(words) if not w[0].isupper() and known[w.lower()]]
    if not small:
        return []
    near = sorted({words[j][0] for k in small for j in range(max(0, k - 2), k + 1) if known[words[j][1].lower()]})
    out: list[tuple] = []
    taken = [m.span() for m in _mails(text)]
    for start, end, a, b, form, second, cased in _pairs(text, near):
        if not cased:
            a, b = a.lower(), b.lower()
            if all(known[x] for x in (*a.split("-"), *b.split("-"))) and all(end <= x or start >= y for x, y in taken):
                out.append(("name", start, end, text[start:end], a, b, f"{form}-loose", "", "", second))
    return out


_TYPES = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [c.split()[0] for c in CANDIDATES.split(", ")])


def _loose(bits: bytes):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sieve(bits)
        for batch in batches:
            d = batch.to_pydict()
            yield _batch_of([(origin, key, turn, *c) for origin, key, turn, text in zip(d["origin"], d["row_key"], d["turn_no"], d["text"], strict=True) for c in loose_names(text, known)])

    return of


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        rows: list[tuple] = []
        seen: Counter = Counter()
        for origin, key, turn, text in zip(d["origin"], d["row_key"], d["turn_no"], d["text"], strict=True):
            rows += [(origin, key, turn, *c) for c in candidates_in(text)]
            seen.update(w.lower() for w in _WORDS.findall(text) if w[0].isupper())
        yield _batch_of(rows + [(None, None, None, "word", None, None, None, w, None, None, None, None, n) for w, n in seen.items()])


def texts_of(memories: DataFrame, cases: DataFrame) -> DataFrame:
    """(origin, row_key, turn_no, text) of all texts; null ids and blank texts have none, repeated rows come once."""
    m = memories.where(F.col("record_id").isNotNull() & ~blank(F.col("text"))).select(F.lit("canonical_memories").alias("origin"), F.col("record_id").cast("string").alias("row_key"), F.lit(0).alias("turn_no"), "text")
    c = cases.where("case_id is not null").select("case_id", F.posexplode("conversation").alias("pos", "turn"))
    c = c.select(F.lit("cases").alias("origin"), F.col("case_id").cast("string").alias("row_key"), (F.col("pos") + 1).alias("turn_no"), F.col("turn.content").alias("text")).where(~blank(F.col("text")))
    return m.unionByName(c).distinct()


def _telling(left: Column, words: Iterable[str]) -> Column:
    return left.rlike(r"(?i)(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})") if words else F.lit(False)


@dataclass(frozen=True)
class Seeds:
    """Words that stand before a number of each class; any list may be empty."""

    phone: tuple[str, ...] = tuple(PHONE_WORDS)
    identity: tuple[str, ...] = tuple(IDENTITY_WORDS)
    thing: tuple[str, ...] = tuple(THING_WORDS)


def score_numbers(numbers: DataFrame, seeds: Seeds = Seeds(), most_rounds: int = 10, still: float = 0.05) -> DataFrame:
    """(shape, left, right, kind) of the number patterns that are phone or identity. Three classes spread between
    patterns and the instances in them; seeds keep their class. It ends when no score has moved by more than ``still``."""
    kinds = ("phone", "identity", "thing")
    label = F.col("a")
    seed = F.when(_telling(label, seeds.identity), "identity").when(_telling(F.concat_ws(" ", label, "right"), seeds.thing), "thing").when(_telling(label, seeds.phone), "phone")
    rows = numbers.groupBy("shape", "left", "right", seed.alias("seed")).agg(F.count("*").alias("n"))
    rows = rows.withColumns({k: F.coalesce((F.col("seed") == k).cast("double"), F.lit(0.0)) for k in kinds})
    rows = keep(rows, "p4-numbers")
    for _ in range(most_rounds):
        scored = rows
        for c, w in (("shape", 0.6), ("left", 0.3), ("right", 0.1)):
            of = rows.groupBy(c).agg(*(((F.sum(F.col(k) * F.col("n")) / F.sum("n")) * w).alias(f"{c}_{k}") for k in kinds))
            scored = scored.join(of, c)
        spread = {k: F.when(F.col("seed").isNotNull(), F.col(k)).otherwise(sum(F.col(f"{c}_{k}") for c in ("shape", "left", "right"))) for k in kinds}
        moved = F.greatest(*(F.abs(v - F.col(k)) for k, v in spread.items())).alias("moved")
        rows = keep(scored.select("shape", "left", "right", "n", "seed", *(v.alias(k) for k, v in spread.items()), moved), "p4-numbers")
        if (rows.agg(F.max("moved")).first()[0] or 0) <= still:
            break
    # the shape has the last word over a seed word nearby: a few of its instances may stand behind a word of another class
    shapes = rows.groupBy("shape").agg(*(((F.sum(F.col(k) * F.col("n")) / F.sum("n"))).alias(f"s_{k}") for k in kinds))
    rows = rows.groupBy("shape", "left", "right").agg(*((F.sum(F.col(k) * F.col("n")) / F.sum("n")).alias(k) for k in kinds))
    all_ = rows.join(shapes, "shape").withColumns({k: F.col(k) * 0.4 + F.col(f"s_{k}") * 0.6 for k in kinds})
    kind = F.when((F.col("phone") > F.col("thing")) & (F.col("phone") >= F.col("identity")) & (F.col("phone") >= 0.25), "phone").when((F.col("identity") > F.col("thing")) & (F.col("identity") >= 0.25), "identity")
    return all_.select("shape", "left", "right", kind.alias("kind")).where("kind is not null").distinct()


def learn_parts(pairs: DataFrame, words: DataFrame, seeds: DataFrame, most_rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """((part, role) of known and learned name parts, pairs of one known part in patterns worth enough); role is given or
    family.

    A pattern (words before, word after) is worth the share of its candidates with one known part whose other part is
    known too. A new part must stand beside known partners, in patterns worth enough, for a fair share of all its
    occurrences. So what often follows given names but never in the patterns of names (a machine, a project) is
    not taken. It ends when a round finds no new part.
    """
    known, n = keep(seeds, "p4-parts"), -1
    cased = pairs.where("shape in ('plain', 'comma')").groupBy("a", "b", "left", "right").agg(F.count("*").alias("n"))
    cased = cased.withColumn("b", F.explode(F.split("b", "-")))
    cased = keep(cased, "p4-pairs")
    for _ in range(most_rounds):
        g = known.where("role = 'given'").select(F.col("part").alias("a"), F.lit(1).alias("g"))
        f = known.where("role = 'family'").select(F.col("part").alias("b"), F.lit(1).alias("f"))
        rows = keep(cased.join(g, "a", "left").join(f, "b", "left").fillna(0, ["g", "f"]), "p4-known")
        worth = lambda c: rows.where("g + f > 0").groupBy(c).agg((F.sum(F.col("n") * F.col("g") * F.col("f")) / (F.sum("n") + 2)).alias(f"{c}_worth"))
        scored = rows.where("g + f = 1").join(worth("left"), "left").join(worth("right"), "right").withColumn("worth", F.greatest("left_worth", "right_worth") * F.least(F.lit(1.0), F.least("left_worth", "right_worth") * 4))
        new = scored.select(F.when(F.col("g") == 1, F.col("b")).otherwise(F.col("a")).alias("part"), F.when(F.col("g") == 1, F.lit("family")).otherwise(F.lit("given")).alias("role"), F.when(F.col("g") == 1, F.col("a")).otherwise(F.col("b")).alias("partner"), "n", "worth")
        new = new.groupBy("part", "role").agg(F.sum(F.col("n") * F.col("worth")).alias("evidence"), F.count_distinct("partner").alias("partners"))
        new = new.join(words, new["part"] == words["word"]).where("evidence >= 0.2 * total and partners >= 2").select("part", "role")
        known = keep(known.unionByName(new).distinct(), "p4-parts")
        before, n = n, known.count()
        if n == before:
            break
    last = scored.where("worth >= 0.3").select("a", F.col("b").alias("b1"), "left", "right").distinct()
    return known, keep(last, "p4-beside")


def found_names(pairs: DataFrame, parts: DataFrame, beside: DataFrame) -> DataFrame:
    """(origin, row_key, turn_no, start, end, found): pairs of known parts in any letter case, and cased pairs of one known
    part in a pattern worth enough."""
    g = parts.where("role = 'given'").select(F.col("part").alias("a"), F.lit(1).alias("g"))
    f = parts.where("role = 'family'").select("part", F.lit(1).alias("f"))
    rows = pairs.withColumns({"b1": F.split("b", "-")[0], "b2": F.coalesce(F.get(F.split("b", "-"), F.lit(1)), F.split("b", "-")[0])})
    straight = rows.join(g, "a").join(f.select(F.col("part").alias("b1")), "b1", "left_semi").join(f.select(F.col("part").alias("b2")), "b2", "left_semi")
    # a pair of one known part yields to a reading of known parts that shares a word with it
    words = straight.select("origin", "row_key", "turn_no", F.explode(F.array("start", "n")).alias("word"))
    near = rows.where("shape in ('plain', 'comma')").join(beside, ["a", "b1", "left", "right"], "left_semi")
    for c in ("start", "n"):
        near = near.join(words.withColumnRenamed("word", c), ["origin", "row_key", "turn_no", c], "left_anti")
    # family first without a comma: the roles change places
    turned = rows.where("shape in ('plain', 'plain-loose')").join(f.select(F.col("part").alias("a")), "a", "left_semi").join(g.select(F.col("a").alias("b")), "b", "left_semi")
    cols = ["origin", "row_key", "turn_no", "start", "end", "found", "shape", "n"]
    hits = keep(straight.select(*cols).unionByName(near.select(*cols)).unionByName(turned.select(*cols).withColumn("shape", F.lit("turned"))).distinct(), "p4-names")
    plain = hits.where("shape in ('plain', 'plain-loose')")
    # "A B, C D" are two names: a reading across the comma yields to a plain one that holds its first word
    second = plain.select("origin", "row_key", "turn_no", F.col("n").alias("start"))
    first = plain.select("origin", "row_key", "turn_no", F.col("start").alias("n"))
    rest = hits.where("shape not in ('plain', 'plain-loose')").join(second, ["origin", "row_key", "turn_no", "start"], "left_anti")
    rest = rest.where("shape <> 'turned'").unionByName(rest.where("shape = 'turned'").join(first, ["origin", "row_key", "turn_no", "n"], "left_anti"), allowMissingColumns=True)
    return plain.unionByName(rest.select(*plain.columns)).select("origin", "row_key", "turn_no", "start", "end", "found")


def learn_streets(places: DataFrame) -> DataFrame:
    """(a): names of streets. A cased street word with a house number is one; other names become streets if they stand
    where such addresses stand."""
    typed = (F.col("b") == "typed").cast("double")
    cased = keep(places.where("b <> 'loose'").groupBy("a", "b", "left", "right").agg(F.count("*").alias("n")), "p4-places")
    worth = cased.groupBy("left").agg((F.sum(F.col("n") * typed) / (F.sum("n") + 2)).alias("worth"))
    learned = cased.join(worth, "left").groupBy("a").agg(F.max(typed).alias("typed"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("worth")) / F.sum("n")).alias("worth"))
    return keep(learned.where("typed = 1 or (n >= 3 and worth >= 0.25)").select("a"), "p4-streets")


def found_mails(mails: DataFrame) -> DataFrame:
    """Addresses with their signs, or with several written-out dots, are seeds, and score the words that stand before them;
    any other address whose signs are written as words is one if it stands behind such words, or if those of its form
    mostly do."""
    known = (F.col("shape") == "signs").cast("double")
    left = mails.groupBy("left").agg((F.sum(known) / (F.count("*") + 1)).alias("worth"))
    scored = mails.join(left, "left")
    form = scored.groupBy("shape").agg(F.avg("worth").alias("form"))
    return scored.join(form, "shape").where("shape = 'signs' or worth >= 0.2 or form >= 0.2")


def sieve_of(parts: DataFrame) -> bytes:
    """A bit for each residue of the hashes of (part): at most ``SIEVE`` numbers reach the driver, however many parts."""
    bits = bytearray(SIEVE // 8)
    hashes = parts.select(F.explode(F.split("part", "-")).alias("p")).select(F.pmod(F.xxhash64("p"), F.lit(SIEVE)).cast("int").alias("at")).distinct()
    for at in hashes.toArrow().column("at").to_pylist():
        bits[at >> 3] |= 1 << (at & 7)
    return bytes(bits)


def found_items(memories: DataFrame, cases: DataFrame, name_parts: DataFrame, seed_words: Seeds = Seeds()) -> DataFrame:
    """(origin, row_key, turn_no, kind, start, end, found_text) of every item; overlapping readings give the longest
    (ties: the first). An empty list of name parts leaves names unfound; texts without items give no rows."""
    texts = texts_of(memories, cases)
    all_ = keep(texts.mapInArrow(_extract, CANDIDATES), "p4-candidates")
    of = lambda hint: all_.where(F.col("hint") == hint)
    cols = ["origin", "row_key", "turn_no", "start", "end", "found"]
    kinds = score_numbers(of("number"), seed_words)
    numbers = of("number").join(kinds, ["shape", "left", "right"]).select(*cols, "kind")
    words = keep(of("word").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("total")), "p4-words")
    seeds = name_parts.where("name_part is not null and part_kind in ('given', 'family')").select(F.lower(F.trim("name_part")).alias("part"), F.col("part_kind").alias("role")).distinct()
    parts, beside = learn_parts(of("name"), words, seeds)
    streets = learn_streets(of("place"))
    other = keep(texts.mapInArrow(_loose(sieve_of(parts)), CANDIDATES), "p4-loose")
    names = found_names(of("name").unionByName(other), parts, beside).withColumn("kind", F.lit("name"))
    places = of("place").join(streets, "a", "left_semi").select(*cols).withColumn("kind", F.lit("address"))
    mails = found_mails(of("email")).select(*cols).withColumn("kind", F.lit("email"))
    hits = numbers.select(*cols, "kind").unionByName(names.select(*cols, "kind")).unionByName(places.select(*cols, "kind")).unionByName(mails.select(*cols, "kind"))
    # the items of one text, longest first: bounded by the text
    lists = hits.groupBy("origin", "row_key", "turn_no").agg(F.array_sort(F.collect_set(F.struct((F.col("start") - F.col("end")).alias("rank"), "start", "end", "kind", "found"))).alias("items"))
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("origin", "row_key", "turn_no", F.explode(kept).alias("x")).select("origin", "row_key", "turn_no", "x.kind", "x.start", "x.end", F.col("x.found").alias("found_text"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
            for i in sorted(items or [], key=lambda i: -i["start"]):
                text = f"{text[: i['start']]}[{i['kind'].upper()}]{text[i['end'] :]}"
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], ["origin", "row_key", "turn_no", "redacted"])


def redacted_texts(memories: DataFrame, cases: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(origin, row_key, turn_no, redacted): every text with a typed placeholder for each item; the rest as it was."""
    keys = ["origin", "row_key", "turn_no"]
    items = found_items(memories, cases, name_parts).groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "kind")).alias("items"))
    return texts_of(memories, cases).join(items, keys, "left").select(*keys, "text", "items").mapInArrow(_redact, "origin string, row_key string, turn_no int, redacted string")
