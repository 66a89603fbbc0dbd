"""The versioned fact store: snapshot diffs, commit plans, rendering and strict parsing, and a stored snapshot that is
replaced as a whole."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import retrieval as R
from larkspur.operators.segments import SegmentStore, StaleVersion

# The classes in their order with their titles and what stands in an empty section; the first three are core,
# the others dynamic.
SECTIONS = (
    ("personal_profile", "Personal Profile", "(Stable background information about the user)"),
    ("preferences", "Preferences", "(How the user prefers to communicate and collaborate)"),
    ("constraints", "Constraints", "(Rules, boundaries, and requirements that must be respected)"),
    ("projects", "Projects", "(Information about ongoing learning and work projects)"),
    ("daily_life", "Daily Life", "(Daily routines, interests, and hobbies)"),
    ("plans_commitments", "Plans and Commitments", "(Future plans, commitments, deadlines, and to-dos)"),
)
HEAD = ("# Long-term Memory", "This file stores important information that should persist across sessions.")
FOOT = "*This file is automatically updated by {writer} when important information should be remembered.*"
CLASSES = tuple(c for c, _, _ in SECTIONS)
CORE = CLASSES[:3]
TRIPLE = ["main_class", "sub_class", "text"]


def class_rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in CLASSES)), c).cast("int")


def violations(main_class: Column, sub_class: Column, text: Column) -> Column:
    """Names of the rules that a fact breaks, joined by commas; empty for a valid fact."""
    rules = {
        "class": ~F.coalesce(main_class, F.lit("")).isin(*CLASSES),
        "sub_class_empty": T.strip(F.coalesce(sub_class, F.lit(""))) == "",
        "text_empty": T.strip(F.coalesce(text, F.lit(""))) == "",
        "line_break": F.concat(F.coalesce(sub_class, F.lit("")), F.coalesce(text, F.lit(""))).rlike(r"[\r\n]"),
        "untrimmed": F.coalesce((T.strip(text) != text) | (T.strip(sub_class) != sub_class), F.lit(False)),
        "separator": F.coalesce(sub_class, F.lit("")).contains(": "),
    }
    return F.array_join(F.filter(F.array(*(F.when(v, F.lit(k)).otherwise(F.lit("")) for k, v in rules.items())), lambda x: x != ""), ",")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, fact, status): added, removed or unchanged, by one full outer join on the whole fact."""
    on = [*key, *TRIPLE]
    both = old.select(*on).distinct().withColumn("o", F.lit(1)).join(new.select(*on).distinct().withColumn("n", F.lit(1)), on, "full")
    return both.select(*on, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("status"))


def commit_plan(diff: DataFrame) -> DataFrame:
    """What a commit does with each changed fact: its store step and, for the dynamic classes only, its index step."""
    dynamic = ~F.col("main_class").isin(*CORE)
    return diff.where("status <> 'unchanged'").select("*", F.when(F.col("status") == "added", "insert").otherwise("delete").alias("store"), F.when(~dynamic, "none").when(F.col("status") == "added", "embed").otherwise("unindex").alias("index"))


def _is_core(c: Column) -> Column:
    return F.coalesce(c.isin(*CORE), F.lit(False))


def render(facts: Column, writer: str = "the engine") -> Column:
    """One Markdown document out of an array of facts (main_class, sub_class, text, memory_id): a head, every class as a
    section, in order, with what stands for an empty one, and a foot. Facts of a section are in the order of slot, id
    and text."""

    def section(main_class: str, title: str, empty: str) -> Column:
        own = F.array_sort(F.transform(F.filter(facts, lambda x: x["main_class"] == main_class), lambda x: F.struct(x["sub_class"].alias("s"), x["memory_id"].alias("i"), x["text"].alias("t"))))
        lines = F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), x["s"], F.lit(": "), x["t"])), "\n")
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(own) > 0, lines).otherwise(F.lit(empty)))

    return F.concat_ws("\n\n", *map(F.lit, HEAD), *(section(*x) for x in SECTIONS), F.lit("---"), F.lit(FOOT.format(writer=writer)))


def context_block(core: Column, found: Column) -> Column:
    """The part of a prompt that holds facts, out of two arrays of (main_class, sub_class, text): core, then retrieved; a
    part without facts is left out, and so is the whole."""
    line = lambda x: F.concat(F.lit("- ["), x["main_class"], F.lit("/"), x["sub_class"], F.lit("] "), x["text"])
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title} Memory\n"), F.array_join(F.transform(c, line), "\n")))
    body = F.concat_ws("\n\n", part("Core", core), part("Retrieved", found))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("# Memory\n\n"), body))


class ParseError(ValueError):
    def __init__(self, line: int, why: str):
        super().__init__(f"line {line}: {why}")
        self.line = line


def parse(document: str) -> list[tuple[str, str, str]]:
    """The facts of a rendered document. The first line that breaks a rule is reported."""
    titles = {title: k for k, (_, title, _) in enumerate(SECTIONS)}
    foot = re.compile(re.escape(FOOT).replace(re.escape("{writer}"), ".+"))
    facts: dict[tuple[str, str, str], int] = {}
    at, empty, n = -1, set(), 0
    for n, line in ((k, x.strip()) for k, x in enumerate(document.splitlines(), 1) if x.strip()):
        if line.startswith("## "):
            k = titles.get(line[3:].strip())
            if k != at + 1:
                raise ParseError(n, "unknown section" if k is None else "repeated section" if k <= at else "section out of order")
            at = k
        elif line in HEAD or line == "---" or foot.fullmatch(line):
            continue
        elif line.startswith("#"):
            raise ParseError(n, "heading of another kind")
        elif at < 0:
            raise ParseError(n, "text before the first section")
        elif line == SECTIONS[at][2]:
            if at in facts.values():
                raise ParseError(n, "note of emptiness after facts")
            empty.add(at)
        else:
            slot, sign, text = line.removeprefix("- ").partition(": ")
            fact = (CLASSES[at], slot.strip(), text.strip())
            if not line.startswith("- ") or not sign or not all(fact):
                raise ParseError(n, "no '- slot: text'")
            if at in empty or fact in facts:
                raise ParseError(n, "fact after a note of emptiness" if at in empty else "repeated fact")
            facts[fact] = at
    if at + 1 != len(SECTIONS):
        raise ParseError(len(document.splitlines()) + 1, "missing sections")
    return list(facts)


FACTS = "memory_id string, main_class string, sub_class string, text string, content_version bigint, live boolean, version bigint"
VECTORS = "memory_id string, v array<float>, content_version bigint"
POSTINGS = "memory_id string, token string, tf bigint, dl int, content_version bigint"
EVENTS = "version bigint, reason string, added bigint, removed bigint, changed bigint"


class FactStore(SegmentStore):
    """A snapshot of facts that commits replace as a whole, its index and its history, as logs of segments.

    A commit names the version that it was made from; of commits from one version one wins and the others are stale.
    It appends what changed, one event, and vectors and postings of the changed facts of dynamic classes. Index rows hold
    for the version in which their fact got its content, so a fact that goes, changes or becomes core loses them with
    the same publication.
    """

    TABLES = ("facts", "vectors", "postings", "events")

    def _latest(self, segments: list) -> DataFrame:
        rows = self.read(segments, FACTS)
        rest = [c for c in rows.columns if c != "memory_id"]
        return rows.groupBy("memory_id").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("memory_id", "v.*")

    def facts(self) -> DataFrame:
        return self._latest(self.manifest()["facts"]).where("live").select("memory_id", *TRIPLE)

    def events(self) -> DataFrame:
        return self.read(self.manifest()["events"], EVENTS)

    def _indexed(self, table: str, schema: str) -> DataFrame:
        m = self.manifest()
        now = self._latest(m["facts"]).where(F.col("live") & ~_is_core(F.col("main_class"))).select("memory_id", "content_version")
        return self.read(m[table], schema).join(now, ["memory_id", "content_version"], "left_semi").drop("content_version")

    def vectors(self) -> DataFrame:
        return self._indexed("vectors", VECTORS)

    def postings(self) -> DataFrame:
        return self._indexed("postings", POSTINGS)

    def commit(self, facts: DataFrame, expected: int, vectors: DataFrame | None = None, reason: str = "") -> int:
        """Replace the snapshot by ``facts`` (memory_id and the triple; a null id becomes the canonical one). ``vectors``
        (memory_id, v) must be those of exactly the facts of dynamic classes that are new or changed. Broken facts,
        repeated ids and other vectors are errors; nothing is written then. Gives the new version."""
        old = self.manifest()
        number, dropped = expected + 1, []
        if old["version"] != expected:
            raise StaleVersion(expected, old["version"])
        new = facts.select(F.coalesce("memory_id", T.canonical_id(F.col("main_class"), F.col("sub_class"), F.col("text"))).alias("memory_id"), *TRIPLE).distinct()
        bad = new.where(violations(F.col("main_class"), F.col("sub_class"), F.col("text")) != "").first()
        if bad:
            raise ValueError(f"broken fact {bad['memory_id']}")
        if not new.groupBy("memory_id").count().where("count > 1").isEmpty():
            raise ValueError("repeated ids")
        had = self._latest(old["facts"]).where("live").select("memory_id", *(F.col(c).alias(f"old_{c}") for c in TRIPLE))
        both = new.withColumn("n", F.lit(True)).join(had.withColumn("o", F.lit(True)), "memory_id", "full")
        same = F.lit(True)
        for c in TRIPLE:
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
        step = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(~same, "changed")
        diff = both.withColumn("step", step).where("step is not null")
        present = lambda c: F.coalesce(c, f"old_{c}").alias(c)
        rows = diff.select("memory_id", *map(present, TRIPLE), F.lit(number).cast("bigint").alias("content_version"), (F.col("step") != "removed").alias("live"), F.lit(number).cast("bigint").alias("version"), "step")
        folder = self.write(rows, "facts")
        written = self.spark.read.schema(f"{FACTS}, step string").parquet(folder)
        dynamic = written.where(F.col("live") & ~_is_core(F.col("main_class")))
        given = vectors if vectors is not None else self.spark.createDataFrame([], "memory_id string, v array<float>")
        if not dynamic.select("memory_id", F.lit(1).alias("d")).join(given.select("memory_id", F.lit(1).alias("g")), "memory_id", "full").where("d is null or g is null").isEmpty():
            self._fs.delete(self._path(folder), True)
            raise ValueError("the vectors aren't those of the changed dynamic facts")
        self.claim(number)
        at = F.lit(number).cast("bigint").alias("content_version")
        tables = {
            "facts": folder,
            "vectors": self.write(given.select("memory_id", F.col("v").cast("array<float>").alias("v"), at), "vectors"),
            "postings": self.write(R.postings(dynamic.select("memory_id", F.concat_ws(" ", "sub_class", "text").alias("text")), "memory_id").select("*", at), "postings"),
            "events": self.write(written.agg(*(F.count_if(F.col("step") == x).alias(x) for x in ("added", "removed", "changed"))).select(F.lit(number).cast("bigint").alias("version"), F.lit(reason).alias("reason"), "added", "removed", "changed").coalesce(1), "events"),
        }
        segments = {t: [*old[t], [0, f]] for t, f in tables.items()}
        segments["facts"] = self.merged(segments["facts"], "facts", dropped, lambda last, oldest: self._latest(last).where("live") if oldest else self._latest(last))
        self.publish({"version": number, "dropped": dropped} | segments, old)
        return number


def convert_workspace(spark: SparkSession, old: DataFrame, path: str, embed, dry_run: bool = False) -> dict:
    """Take the facts of an old workspace (memory_id and the triple) into a new store. Gives the preflight report: facts,
    repeated ids with other contents (conflicts), broken facts. Conflicts or broken facts, or a store that is there
    already, stop it; ``embed`` makes (memory_id, v) of facts. Until the store is published a file ``REBUILD_REQUIRED``
    lies beside it, so that a run that died is seen and the copy made anew."""
    store = FactStore(spark, path)
    facts = old.select("memory_id", *TRIPLE).distinct()
    n = facts.agg(F.count("*").alias("facts"), F.count_if(violations(F.col("main_class"), F.col("sub_class"), F.col("text")) != "").alias("broken")).first()
    report = {"facts": n["facts"], "broken": n["broken"], "conflicts": facts.where("memory_id is not null").groupBy("memory_id").count().where("count > 1").count(), "exists": store.version() > 0}
    if dry_run:
        return report
    if report["broken"] or report["conflicts"] or report["exists"]:
        raise ValueError(f"not converted: {json.dumps(report)}")
    marker = store._path(f"{store.path}/REBUILD_REQUIRED")
    store._fs.create(marker, True).close()
    store.recover()
    store.commit(facts, 0, embed(facts.where(~_is_core(F.col("main_class")))), "conversion")
    store._fs.delete(marker, False)
    return report


class Publication:
    """A document beside a store, published in two steps: ``stage`` names the text that is expected now and the text that
    shall be, ``confirm`` takes it as published once it is written. What was staged and not confirmed is seen on restart.
    ``baseline`` accepts a text that came from outside. The state is one small record in a folder that all share,
    replaced by a commit of a ``SegmentStore``, so that of two writers one is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = SegmentStore(spark, path)

    def state(self) -> dict:
        m = self.store.manifest()
        return {"revision": m.get("revision", 0), "text": m.get("text", ""), "pending": m.get("pending")}

    def _put(self, state: dict) -> None:
        old = self.store.manifest()
        self.store.claim(old["version"] + 1)
        self.store.publish({"version": old["version"] + 1, "dropped": []} | state, old)

    def stage(self, expected: str, target: str) -> int:
        """Announce ``target`` in place of ``expected``; gives its revision. Something staged, or another present text, is
        an error."""
        s = self.state()
        if s["pending"] is not None:
            raise ValueError("something is staged already")
        if s["text"] != expected:
            raise ValueError("the published text is another one")
        revision = s["revision"] + 1
        self._put(s | {"pending": {"revision": revision, "expected": expected, "target": target}})
        return revision

    def confirm(self, revision: int) -> None:
        s = self.state()
        if s["pending"] is None or s["pending"]["revision"] != revision:
            raise StaleVersion(revision, s["revision"])
        self._put({"revision": revision, "text": s["pending"]["target"], "pending": None})

    def baseline(self, text: str) -> int:
        s = self.state()
        self._put({"revision": s["revision"] + 1, "text": text, "pending": None})
        return s["revision"] + 1
