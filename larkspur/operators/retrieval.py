"""Hybrid retrieval for a table of queries: postings and BM25, exact vector search in blocks, rank fusion, gates,
reranking, aggregation to parents and budgeted evidence. Every operator takes all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.session import keep

RRF_K = 60
COVERAGE_BONUS = 0.001


def _tokenizer(cjk: str, suffixes: tuple[str, ...]):
    """A function that makes a function from a text in UTF-8 to the set of its tokens. Texts without CJK are cut by a table
    of bytes; the forms of a run of signs are made once for all its places. An expression can do neither."""

    def start():
        import re

        runs, latin = re.compile(f"[A-Za-z0-9_]+|[{cjk}]+"), re.compile("[A-Za-z0-9_]")
        word = b"abcdefghijklmnopqrstuvwxyz0123456789_"
        table = bytes(c if (c := ord(chr(x).lower()) if x < 128 else x) in word else 1 if 0xE3 <= x <= 0xE9 else 32 for x in range(256))  # 1: may begin a CJK sign
        ends = tuple(s.encode() for s in suffixes)
        known: dict[str, list[bytes]] = {}
        cut: dict[bytes, list[bytes]] = {}

        def forms(run: str) -> list[bytes]:
            m = run.lower()
            if latin.match(m):
                made = [m.strip("_"), *(m[: -len(s)].strip("_") for s in suffixes if m.endswith(s) and len(m) - len(s) >= 2)]
            else:
                made = [*(m[i : i + 2] for i in range(len(m) - 1)), *m]
            if len(known) > 200_000:
                known.clear()
            known[run] = [t.encode() for t in made if t]
            return known[run]

        def shorter(run: bytes) -> list[bytes]:
            if len(cut) > 200_000:
                cut.clear()
            cut[run] = [run[: -len(s)] for s in ends if run.endswith(s) and len(run) - len(s) >= 2]
            return cut[run]

        def tokens(text: bytes) -> set[bytes]:
            plain = text.translate(table)
            if b"\x01" not in plain:
                seen = set(plain.split())
                odd = [r for r in seen if b"_" in r] if b"_" in plain else []
                seen.difference_update(odd)
                for run in [r for r in seen if r.endswith(ends)]:
                    got = cut.get(run)
                    seen.update(shorter(run) if got is None else got)
                for run in odd:
                    seen.update(forms(run.decode()))
                return seen
            seen = set()
            for run in set(runs.findall(text.decode())):
                got = known.get(run)
                seen.update(forms(run) if got is None else got)
            return seen

        return tokens

    return start


def _entries(key: str, start, asked: bytes | frozenset[bytes] | None, suffixes: tuple[str, ...] = T.SUFFIXES, width: int = 1 << 22):
    """Rows (key, row, text) to rows (key, row, nth, dl, e). nth is another number for each row. Texts are cut ``width`` bytes at
    a time, by array functions over all their words; those that may have CJK signs one by one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        from zlib import crc32

        import pyarrow.compute as pc
        from pyspark import TaskContext

        tokens_of = start()
        task = TaskContext.get()
        nth = (task.partitionId() if task else 0) << 33
        word = b"abcdefghijklmnopqrstuvwxyz0123456789_"
        table = bytes(c if (c := ord(chr(x).lower()) if x < 128 else x) in word else 1 if 0xE3 <= x <= 0xE9 else 32 for x in range(256))  # 1: may begin a CJK sign
        these = pa.array(sorted(asked), pa.binary()).cast(pa.string()) if isinstance(asked, frozenset) else None

        def wanted(vocab: pa.Array) -> np.ndarray:
            if asked is None:
                return np.ones(len(vocab), bool)
            if these is not None:
                return pc.is_in(vocab, value_set=these).to_numpy(zero_copy_only=False)
            bits = (crc32(t) % (8 * len(asked)) for t in vocab.cast(pa.binary()).to_pylist())
            return np.fromiter((asked[bit >> 3] >> (bit & 7) & 1 for bit in bits), bool, len(vocab))

        def spread(codes: np.ndarray, of_code: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
            """For each of ``codes`` all places where ``of_code`` has it, as (place in codes, place in of_code)."""
            order, degree = np.argsort(of_code, kind="stable"), np.bincount(of_code, minlength=many)
            first, n = (np.cumsum(degree) - degree)[codes], degree[codes]
            at = np.repeat(np.arange(len(codes)), n)
            return at, order[np.arange(len(at)) - (np.cumsum(n) - n - first)[at]]

        def plain(text: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
            """(lengths, row of each posting, its token, tf) of texts that the table has cut."""
            n = len(offsets) - 1
            words = pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(text)), " ")
            runs = words.flatten().dictionary_encode()
            code, runs = runs.indices.to_numpy(), runs.dictionary
            odd = pc.match_substring(runs, "_").to_numpy(zero_copy_only=False)
            size = pc.binary_length(runs).to_numpy()
            of_run, forms = [], [runs]
            for s in suffixes:
                hit = np.flatnonzero(pc.ends_with(runs, s).to_numpy(zero_copy_only=False) & ~odd & (size >= len(s) + 2))
                of_run.append(hit)
                forms.append(pc.utf8_slice_codeunits(runs.take(pa.array(hit)), 0, -len(s)))
            at = np.flatnonzero(odd)
            several = [(k, t) for k, m in zip(at.tolist(), runs.take(pa.array(at)).to_pylist()) for t in (m.strip("_"), *(m[: -len(s)].strip("_") for s in suffixes if m.endswith(s) and len(m) - len(s) >= 2)) if t]
            of_run = np.concatenate([*of_run, np.array([k for k, _ in several], np.int64)])
            forms = pa.concat_arrays([*forms, pa.array([t for _, t in several], pa.string())]).dictionary_encode()
            of_form, vocab = forms.indices.to_numpy()[len(runs) :], forms.dictionary  # a run has its place in runs here too
            bits = max(1, len(vocab).bit_length())
            kind = np.uint32 if n < 1 << (32 - bits) else np.int64

            def distinct(doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                pairs = np.sort((doc.astype(kind) << kind(bits)) | token.astype(kind))
                if len(pairs):
                    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
                return (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64)

            doc, token = distinct(pc.list_parent_indices(words).to_numpy(), code)
            longer, is_token = np.zeros(len(runs), bool), ~odd & (size > 0)
            longer[of_run] = True
            cut = np.flatnonzero(longer[token])
            at, form = spread(token[cut], of_run, len(runs))
            keep = is_token[token]
            doc, token = distinct(np.concatenate([doc[keep], doc[cut][at]]), np.concatenate([token[keep], of_form[form]]))
            at = np.flatnonzero(pc.match_substring(vocab, "_").to_numpy(zero_copy_only=False))
            split = [(k, t) for k, m in zip(at.tolist(), vocab.take(pa.array(at)).to_pylist()) for t in m.split("_") if t]
            used = wanted(vocab)
            if not split:
                lengths, keep = np.bincount(doc, minlength=n), used[token]
                return lengths, doc[keep], vocab.take(pa.array(token[keep])), np.ones(np.count_nonzero(keep), np.int64)
            # only parts of tokens with _ can repeat
            is_split = np.zeros(len(vocab), bool)
            is_split[at] = True
            both = pa.concat_arrays([vocab, pa.array([t for _, t in split], pa.string())]).dictionary_encode()  # the places of vocab stay
            cut, rest = np.flatnonzero(is_split[token]), ~is_split[token]
            at, part = spread(token[cut], np.array([k for k, _ in split]), len(vocab))
            lengths = np.bincount(doc[rest], minlength=n) + np.bincount(doc[cut][at], minlength=n)
            rest &= used[token]
            part, at = both.indices.to_numpy()[len(vocab) :][part], doc[cut][at]
            vocab, used = both.dictionary, np.concatenate([used, wanted(both.dictionary.slice(len(vocab)))])
            keep = used[part]
            doc, token, bits = np.concatenate([doc[rest], at[keep]]), np.concatenate([token[rest], part[keep]]), len(vocab).bit_length()
            pairs, tf = np.unique((doc << bits) | token, return_counts=True)
            return lengths, pairs >> bits, vocab.take(pa.array(pairs & ((1 << bits) - 1))), tf

        def one_by_one(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
            lengths, rows, tokens, counts = [], [], [], []
            for row, text in enumerate(texts):
                parts: Counter = Counter()
                for t in tokens_of(text):
                    parts.update(x for x in t.split(b"_") if x)
                lengths.append(sum(parts.values()))
                rows.extend([row] * len(parts))
                tokens.extend(parts)
                counts.extend(parts.values())
            tokens = pa.array(tokens, pa.binary()).cast(pa.string())
            keep = wanted(tokens)
            return np.array(lengths), np.array(rows, np.int64)[keep], tokens.filter(pa.array(keep)), np.array(counts, np.int64)[keep]

        def made(part: pa.RecordBatch, lengths: np.ndarray, rows: np.ndarray, tokens: pa.Array, tf: np.ndarray) -> pa.RecordBatch:
            nonlocal nth
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))])
            e = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([tokens, pa.array(tf, pa.int64())], ["token", "tf"]))
            nth += part.num_rows
            return pa.RecordBatch.from_arrays([part.column(key), part.column("row"), pa.array(np.arange(nth - part.num_rows, nth)), pa.array(lengths, pa.int32()), e], [key, "row", "nth", "dl", "e"])

        for whole in batches:
            texts = whole.column("text").cast(pa.binary())
            places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(places, places[at] + width, "right")) - 1)
                part, offsets = whole.slice(at, to - at), places[at : to + 1] - places[at]
                text = texts.buffers()[2].slice(places[at], offsets[-1]).to_pybytes().translate(table) if offsets[-1] else b""
                if b"\x01" in text:
                    marks = np.flatnonzero(np.frombuffer(text, np.uint8) == 1)
                    wide = np.zeros(to - at, bool)
                    wide[np.searchsorted(offsets, marks, "right") - 1] = True
                    some = part.filter(pa.array(wide))
                    yield made(some, *one_by_one(some.column("text").cast(pa.binary()).to_pylist()))
                    part, kept = part.filter(pa.array(~wide)), [text[offsets[k] : offsets[k + 1]] for k in np.flatnonzero(~wide)]
                    text, offsets = b"".join(kept), np.cumsum([0, *map(len, kept)])
                if part.num_rows:
                    yield made(part, *plain(text, offsets))
                at = to

    return of


FEW_TERMS, TERM_BITS = 1 << 18, 1 << 22


def asked_for(terms: DataFrame, few: int = FEW_TERMS) -> bytes | frozenset[bytes]:
    """The terms of a search for those who make its index: themselves if they are few, else a bit map of fixed size of their
    hashes, in which each of them is."""
    terms = terms.select(F.col("token").cast("binary").alias("token")).distinct()
    first = terms.limit(few + 1).collect()
    if len(first) <= few:
        return frozenset(bytes(r["token"]) for r in first)
    bit = F.pmod(F.crc32("token"), F.lit(TERM_BITS))
    parts = terms.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
    made = bytearray(TERM_BITS // 8)
    for r in parts:
        made[r["part"] << 12 : (r["part"] + 1) << 12] = r["bits"]
    return bytes(made)


def entries(docs: DataFrame, key: str = "doc_id", text: str = "text", asked: bytes | frozenset[bytes] | None = None, repeats: bool = False) -> DataFrame:
    """(key, dl, e): the postings of each document, e an array of (token, tf). Index text is the distinct tokens, re-split
    on ``_``; dl counts them with repeats. Null keys and texts have none; a text without tokens has none. A key must stand
    in one row; with ``repeats``, rows that are alike in all columns count as one. With ``asked``, of
    ``asked_for``, e has the tokens asked for, besides them only such as share a bit with one; dl still counts all."""
    made = places(docs, key, text, asked)
    if repeats:  # entries are smaller than texts
        made = made.dropDuplicates([key, "row"])
    return made.drop("row", "nth")


def places(docs: DataFrame, key: str = "doc_id", text: str = "text", asked: bytes | frozenset[bytes] | None = None) -> DataFrame:
    """(key, row, nth, dl, e): ``entries`` of all rows, repeated ones too, without a shuffle. row is the same for rows that are
    alike, nth another number for each, until it is kept another one each time."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.xxhash64(*docs.columns).alias("row"), F.col(text).alias("text"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, row bigint, nth bigint, dl int, e array<struct<token:string,tf:bigint>>"
    return rows.mapInArrow(_entries(key, _tokenizer(T.CJK, T.SUFFIXES), asked), schema).where("dl > 0")


def once(kept: DataFrame, key: str = "doc_id", few: int = 1 << 18) -> DataFrame:
    """Entries of ``places``, which were kept, with rows that are alike counted as one. Only keys are shuffled; where few rows
    are repeated, no entry is."""
    many = keep(kept.groupBy(key, "row").agg(F.count("*").alias("many"), F.min("nth").alias("first")).where("many > 1").select(key, "row", "first"), "repeats")
    n = many.count()
    if n == 0:
        return kept.drop("row", "nth")
    rows = kept.join(F.broadcast(many) if n <= few else many, [key, "row"], "left").where("first is null or first = nth").drop("row", "nth", "first")
    return rows if n <= few else keep(rows, "entries")


def flat(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries as (key, token, tf, dl)."""
    return index.select(key, "dl", F.explode("e").alias("x")).select(key, "x.token", "x.tf", "dl")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token, tf, dl): the inverted index. The postings of a row are made within that row, so nothing is shuffled."""
    return flat(entries(docs, key, text), key)


def corpus_stats(index: DataFrame, key: str = "doc_id") -> tuple[int, float]:
    """(documents, mean length): one row for the driver."""
    row = index.select(key, "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return row["n"], row["avgdl"] or 1.0


def query_postings(queries: DataFrame, query_key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_key, token): distinct terms of each query; terms with ``_`` would be phrases and are left out."""
    return terms_asked(with_terms(queries.select(query_key, text), text), query_key)


def terms_asked(queries: DataFrame, query_key: str = "query_id") -> DataFrame:
    """``query_postings`` of queries that have their terms."""
    return queries.select(query_key, F.explode("terms").alias("token")).where(~F.col("token").contains("_")).distinct()


def _terms(text: str, cjk: str, suffixes: tuple[str, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs, sign = re.compile(f"[A-Za-z0-9_]+|[{cjk}]+"), re.compile(f"[{cjk}]")

        def terms(query: str) -> list[str]:
            made: dict[str, None] = {}
            for run in runs.findall(query):
                m = run.lower()
                if sign.match(m):
                    forms = [*(m[i : i + 2] for i in range(len(m) - 1)), *m]
                else:
                    forms = [m.strip("_"), *(m[: -len(s)].strip("_") for s in suffixes if m.endswith(s) and len(m) - len(s) >= 2)]
                made.update((t, None) for t in forms if t)
            many = len(sign.findall(query)) > 1
            return [t for t in made if not (many and sign.fullmatch(t))]

        for batch in batches:
            found = [None if q is None else terms(q) for q in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "terms"])

    return of


def with_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """``queries`` and the column terms, what ``query_terms`` makes of ``text``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(_terms(text, T.CJK, T.SUFFIXES), schema + ", terms array<string>")


def bm25(index: DataFrame, terms: DataFrame, key: str = "doc_id", query_key: str = "query_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_key, key, bm25) with idf ln((N - n + .5) / (n + .5)), at least 1e-6. Only postings of query terms are
    shuffled, and their scores are summed with map-side combining."""
    n, avgdl = corpus_stats(index, key)
    asked = index.join(terms.select("token").distinct(), "token", "left_semi")
    df = asked.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = asked.join(df.select("token", idf.alias("idf")), "token").select("token", key, (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))).alias("w"))
    return terms.join(weighted, "token").groupBy(query_key, key).agg(F.round(F.sum("w"), 6).alias("bm25"))


def _lane_best(key: str, query_key: str, k: int, avgdl: float, k1: float, b: float):
    """The k best of one lane of documents for each query of one block, as (query_key, key, bm25).

    Terms of more than a 32nd of the lane's documents are common. Queries that have the same common terms share their sums,
    made once, and of documents without any other term of the query only the best of those sums are looked at. Where k
    documents with other terms are above all that the common ones can give, those sums aren't needed. Rounded scores can tie
    within 1e-6, hence the margin."""

    def of(docs: pa.Table, asks: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        asks = asks.combine_chunks()
        vocab = pc.unique(asks.column("token"))
        asked = pc.index_in(asks.column("token"), value_set=vocab).to_numpy()
        idf = np.zeros(len(vocab))
        idf[asked] = asks.column("idf").to_numpy()
        e = docs.column("e").combine_chunks()
        e = pa.concat_arrays(e.chunks) if isinstance(e, pa.ChunkedArray) else e
        flat, row = e.flatten(), pc.list_parent_indices(e).to_numpy()
        term = pc.index_in(flat.field("token"), value_set=vocab)
        mine = pc.is_valid(term).to_numpy(zero_copy_only=False)
        term, row, tf = pc.fill_null(term, -1).to_numpy()[mine], row[mine], flat.field("tf").to_numpy()[mine].astype(np.float64)
        names = docs.column(key).unique()
        names = names.take(pc.sort_indices(names))  # places in the order of the keys, for ties
        n = len(names)
        at = pc.index_in(docs.column(key), value_set=names).to_numpy()[row]
        w = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * docs.column("dl").to_numpy()[row] / avgdl))
        order = np.argsort(term.astype(np.int64) * n + at)
        at, w = at[order], w[order]
        starts = np.searchsorted(term[order], np.arange(len(vocab) + 1))
        lists = [(at[x:y], w[x:y]) for x, y in zip(starts[:-1], starts[1:])]
        most = [ws.max() if len(ws) else 0.0 for _, ws in lists]
        queries = pc.unique(asks.column(query_key))
        of_query = pc.index_in(asks.column(query_key), value_set=queries).to_numpy()
        order = np.argsort(of_query, kind="stable")
        asked = asked[order]
        ends = np.searchsorted(of_query[order], np.arange(len(queries) + 1))
        alike: dict[tuple[int, ...], list[tuple[int, list[int]]]] = {}
        for nth in range(len(queries)):
            terms = [int(t) for t in asked[ends[nth] : ends[nth + 1]] if len(lists[t][0])]
            if terms:
                common = tuple(sorted(t for t in terms if 32 * len(lists[t][0]) > n))
                alike.setdefault(common, []).append((nth, [t for t in terms if t not in common]))
        rounded = lambda x: np.floor(x * 1e6 + 0.5)

        def first(scores: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
            """Places of the best, ties by id."""
            if len(scores) > many:
                some = np.flatnonzero(scores >= -np.partition(-scores, many - 1)[many - 1])
                return some[np.lexsort((ids[some], -scores[some]))[:many]]
            return np.lexsort((ids, -scores))

        acc, stamp = np.zeros(n), np.full(n, -1)
        which, found, scores = [], [], []
        for common, members in alike.items():
            can, base, top = sum(most[t] for t in common), None, None
            for nth, rare in members:
                ids = np.concatenate([lists[t][0] for t in rare]) if rare else np.empty(0, at.dtype)
                for t in rare:
                    acc[lists[t][0]] += lists[t][1]
                stamp[ids] = nth
                if len(rare) > 1:
                    ids = np.unique(ids)
                own = acc[ids]
                acc[ids] = 0
                enough = len(ids) >= k and -np.partition(-own, k - 1)[k - 1] > can + 2e-6
                if common and not enough and base is None:
                    base = np.zeros(n)
                    for t in common:
                        base[lists[t][0]] += lists[t][1]
                if base is not None:
                    own = own + base[ids]
                else:
                    for t in common:
                        place = np.minimum(np.searchsorted(lists[t][0], ids), len(lists[t][0]) - 1)
                        hit = lists[t][0][place] == ids
                        own[hit] += lists[t][1][place[hit]]
                own = rounded(own)
                if common and not enough:
                    if top is None:
                        some = np.flatnonzero(base)
                        top = some[first(rounded(base[some]), some, 4 * k)]
                    others = top[stamp[top] != nth]
                    if len(others) < k and len(top) >= 4 * k:  # more of the best have a rare term than were set aside
                        some = np.flatnonzero((base > 0) & (stamp != nth))
                        others = some[first(rounded(base[some]), some, k)]
                    ids, own = np.concatenate([ids, others[:k]]), np.concatenate([own, rounded(base[others[:k]])])
                best = first(own, ids, k)
                which.append(np.full(len(best), nth))
                found.append(ids[best])
                scores.append(own[best] / 1e6)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        return pa.table([queries.take(pa.array(join(which, np.int64))), names.take(pa.array(join(found, np.int64))), pa.array(join(scores, np.float64))], [query_key, key, "bm25"])

    return of


def bm25_top(index: DataFrame, terms: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", k1: float = 1.2, b: float = 0.75, lane: int = 1 << 20, block: int = 1 << 17) -> DataFrame:
    """(query_key, key, bm25, rank): the k best documents of each query, those of ``ranked(bm25(...))``, from entries that
    were kept, with all tokens or those asked for.

    The scores of all pairs grow with the square of the data, so they never become rows: documents are spread over lanes
    of at most about ``lane`` postings, queries over blocks of about ``block`` terms, and of each pair of them only the k
    best come out. Each lane brings k rows a query, so there are no more of them than keep all cores busy."""
    spark = index.sparkSession
    # a document's length goes along as a posting of the token null, so that the index is read once
    length = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.col("dl").cast("long").alias("tf")))
    df = keep(index.select(F.explode(F.concat("e", length)).alias("x")).groupBy("x.token").agg(F.count("*").alias("df"), F.sum("x.tf").alias("tf")), "df")
    here = F.col("token").isNull()
    row = df.agg(F.sum(F.when(here, F.col("df"))).alias("n"), F.sum(F.when(here, F.col("tf"))).alias("total"), F.sum(F.when(~here, F.col("df"))).alias("many")).first()
    n, many = row["n"] or 0, row["many"] or 0
    avgdl = row["total"] / n if n else 1.0
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    terms = keep(terms.select(query_key, "token").join(df.select("token", idf.alias("idf")), "token"), "terms")
    n_blocks = max(1, -(-terms.count() // block))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    lanes = max(1, -(-many // lane), min(-(-tasks // n_blocks), -(-many * 16 // lane)))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    docs = index.select(key, "dl", "e", F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int").alias("lane"), every(n_blocks).alias("nth"))
    asks = terms.withColumn("nth", F.pmod(F.xxhash64(query_key), F.lit(n_blocks)).cast("int")).withColumn("lane", every(lanes))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((terms, query_key), (index, key))) + ", bm25 double"
    best = docs.groupBy("lane", "nth").cogroup(asks.groupBy("lane", "nth")).applyInArrow(_lane_best(key, query_key, k, avgdl, k1, b), schema)
    return ranked(best, "bm25", key, k, query_key)


def ranked(scores: DataFrame, score: str, key: str, k: int | None, query_key: str = "query_id", rank: str = "rank", ascending: bool = False) -> DataFrame:
    """The best k rows of each query with their rank; ties by key."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    rows = scores.withColumn(rank, F.row_number().over(Window.partitionBy(query_key).orderBy(order, F.col(key).asc())))
    return rows if k is None else rows.where(F.col(rank) <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero norm or unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector has no direction and is an error."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(v.isNull(), F.lit(None)).when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.raise_error(F.lit("a zero vector can't be normalised")))


def _pack(width: int):
    """Rows (id, v) of one length to rows (ids, flat) of up to ``width`` vectors, buffer by buffer."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                n, flat = part.num_rows, part.column("v").flatten()
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([whole(part.column("id")), whole(flat.cast(pa.float32())), pa.array([len(flat) // n], pa.int32())], ["ids", "flat", "dim"])

    return of


def _score(k: int | None, metric: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("q_ids", "q_flat", "ids", "flat")}
            for row, dim in enumerate(batch.column("dim").to_pylist()):
                qids, q, ids, v = (x[off[row] : off[row + 1]] for off, x in values.values())
                q, v = q.reshape(-1, dim).astype(np.float64), v.reshape(-1, dim).astype(np.float64)
                dots = q @ v.T
                nq, nv = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
                norms = nq[:, None] * nv[None, :]
                cos = np.round(np.divide(dots, norms, out=np.zeros(norms.shape), where=norms > 0), 6) + 0.0
                dist = np.round(np.sqrt(np.maximum(nq[:, None] ** 2 + nv[None, :] ** 2 - 2 * dots, 0)), 6)
                by = -cos if metric == "cosine" else dist
                if k is not None and k < len(ids):  # the k best and their ties, then in order
                    last = np.partition(by, k - 1, axis=1)[:, k - 1 : k]
                else:
                    last = by.max(axis=1, keepdims=True)
                at, to = np.nonzero(by <= last)
                order = np.lexsort((ids[to], by[at, to], at))
                at, to = at[order], to[order]
                if k is not None:
                    nth = np.arange(len(at)) - np.searchsorted(at, at)
                    at, to = at[nth < k], to[nth < k]
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids[to]), pa.array(cos[at, to]), pa.array(dist[at, to])], ["query_id", "id", "similarity", "distance"])

    return of


def vector_search(vectors: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", block: int = 1024) -> DataFrame:
    """(query_id, id, similarity, distance, rank): exact search of the stated queries (query_id, v) in all vectors (id, v).

    Both sides are packed into blocks. Query blocks are numbered; each vector block goes to all of them, in one of so many
    lanes that there is a task for each shuffle partition. One matrix product a pair of blocks gives its best k, and only
    those reach the ranking. Null vectors are left out. A vector of another length than the query has similarity 0 by
    cosine and no distance; by distance it is an error. Zero vectors have similarity 0.
    """
    spark = vectors.sparkSession
    clean = lambda df, key: df.where(F.col(key).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"), F.size("v").alias("dim"))
    v, q = clean(vectors, "id"), clean(queries, "query_id")
    counts = q.select("dim", F.lit(True).alias("asks")).unionByName(v.select("dim", F.lit(False).alias("asks"))).groupBy("dim", "asks").count().collect()  # two rows a length
    asked, there = {r[0]: r[2] for r in counts if r[1]}, [r[0] for r in counts if not r[1]]
    if not asked or not there:
        return spark.createDataFrame([], "query_id long, id long, similarity double, distance double, rank int")
    if metric != "cosine" and set(asked) | set(there) != set(asked) & set(there) or metric != "cosine" and len(there) > 1:
        raise ValueError(f"vectors of {sorted(there)} and queries of {sorted(asked)} numbers")
    best = None
    for dim, n in asked.items():
        if dim not in there:
            continue
        n_blocks = -(-n // block)
        lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
        q_blocks = q.where(F.col("dim") == dim).select("id", "v").mapInArrow(_pack(block), "ids array<long>, flat array<float>, dim int")
        q_blocks = q_blocks.select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.pmod(F.xxhash64("q_ids"), F.lit(n_blocks)).alias("nth"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
        v_blocks = v.where(F.col("dim") == dim).select("id", "v").mapInArrow(_pack(block), "ids array<long>, flat array<float>, dim int")
        v_blocks = v_blocks.select("ids", "flat", "dim", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("nth"))
        found = v_blocks.join(q_blocks, ["nth", "lane"]).select("q_ids", "q_flat", "ids", "flat", "dim").mapInArrow(_score(k, metric), "query_id long, id long, similarity double, distance double")
        best = found if best is None else best.unionByName(found)
    for dim in there:  # of each other length the first ids are enough, since their similarity is the same
        others = [x for x in asked if x != dim]
        if others:
            ids = v.where(F.col("dim") == dim).select("id").distinct().orderBy("id")
            first = [r[0] for r in (ids.limit(k) if k is not None else ids).collect()]
            zero = q.where(F.col("dim").isin(*others)).select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, first)).cast("array<long>")).alias("id"), F.lit(0.0).alias("similarity"), F.lit(None).cast("double").alias("distance"))
            best = zero if best is None else best.unionByName(zero)
    return ranked(best, "similarity" if metric == "cosine" else "distance", "id", k, ascending=metric != "cosine")


def rrf(lists: list[tuple[str, DataFrame]], key: str, query_key: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: (query_key, key, rrf_score, sources), sources in the order of the lists."""
    both = None
    for k, (name, df) in enumerate(lists):
        rows = df.select(query_key, key, "rank", F.lit(k).alias("nth"), F.lit(name).alias("source"))
        both = rows if both is None else both.unionByName(rows)
    fused = both.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("rrf_score"), F.array_sort(F.collect_set(F.struct("nth", "source"))).alias("s"))
    return fused.select(query_key, key, "rrf_score", F.array_join(F.col("s.source"), ",").alias("sources"))


def _found(start):
    """Adds to rows with terms and text which of the terms are tokens of the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, last, seen = start(), None, set()
        for batch in batches:
            found = []
            for terms, text in zip(batch.column("terms").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text is not None and text != last:  # after a join rows of one text stand together
                    last, seen = text, tokens_of(text)
                found.append(None if terms is None or text is None else [t for t in terms if t.encode() in seen])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "found"])

    return of


def with_found(rows: DataFrame) -> DataFrame:
    """``rows`` and the column found: those of the array ``terms`` that are tokens of ``text``, null where either is. As
    tokens of the text it gives the same overlaps and gates."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_found(_tokenizer(T.CJK, T.SUFFIXES)), schema + ", found array<string>")


def overlap_score(terms: Column, document_tokens: Column) -> Column:
    """The default reranker: the share of the query's distinct terms in the document."""
    return F.when(F.size(terms) > 0, F.round(F.size(F.array_intersect(terms, document_tokens)) / F.size(terms), 6)).otherwise(F.lit(0.0))


def parent_aggregate(children: DataFrame, score: str = "rerank_score") -> DataFrame:
    """(query_id, parent_id, best, parent_score, parent_rank): the best child's score and a small bonus for a second."""
    top = children.groupBy("query_id", "parent_id").agg(F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2).alias("two"))
    second = F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    bonus = F.when(second > 0, F.least(F.lit(COVERAGE_BONUS), second * COVERAGE_BONUS)).otherwise(F.lit(0.0))
    scored = top.select("query_id", "parent_id", F.col("two")[0].alias("best"), F.round(F.col("two")[0] + bonus, 9).alias("parent_score"))
    return ranked(scored, "parent_score", "parent_id", None, rank="parent_rank")


def with_parents(children: DataFrame, score: str = "rerank_score", rank: str = "rerank_rank") -> DataFrame:
    """``children`` that have a parent, with the parent_score and parent_rank of ``parent_aggregate``. All of it happens where
    the rows of a query are, so they are neither shuffled twice nor joined."""
    own = Window.partitionBy("query_id", "parent_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.coalesce(F.nth_value(score, 2).over(own), F.lit(0.0))
    bonus = F.when(second > 0, F.least(F.lit(COVERAGE_BONUS), second * COVERAGE_BONUS)).otherwise(F.lit(0.0))
    scored = children.withColumn("parent_score", F.round(F.first(score).over(own) + bonus, 9))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("parent_score").desc(), F.col("parent_id").asc()))
    return scored.withColumn("parent_rank", place).where("parent_id is not null")


def evidence_select(children: DataFrame, doc_limit: int = 10, evidence_limit: int = 5, per_parent: int = 2, budget: int = 4000, threshold: float = 0.2) -> DataFrame:
    """(query_id, child_id, parent_id, nth): greedy choice in candidate order (parent_rank, rerank_rank).

    ``children`` has query_id, child_id, parent_id, parent_rank, rerank_rank, rerank_score, child_cost, parent_cost. A
    rejected child takes no slot; a parent's cost is charged with its first child. The candidates of a query are its
    rerank pool, a bounded list, folded in one expression.
    """
    pool = children.where(F.col("rerank_score") >= threshold).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("parent_rank", "rerank_rank", "child_id", "parent_id", "child_cost", "parent_cost"))).alias("pool"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("parents"), F.array().cast("array<bigint>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        here = F.size(F.filter(acc["parents"], lambda p: p == x["parent_id"]))
        cost = x["child_cost"] + F.when(here == 0, x["parent_cost"]).otherwise(F.lit(0))
        fits = (F.size(acc["chosen"]) < evidence_limit) & (here < per_parent) & ((here > 0) | (F.size(F.array_distinct(acc["parents"])) < doc_limit)) & (acc["used"] + cost <= budget)
        return F.when(fits, F.struct((acc["used"] + cost).cast("long").alias("used"), F.concat(acc["parents"], F.array(x["parent_id"])).alias("parents"), F.concat(acc["chosen"], F.array(x["child_id"])).alias("chosen"))).otherwise(acc)

    done = pool.select("query_id", F.aggregate("pool", start, step).alias("r"))
    out = done.select("query_id", F.posexplode(F.arrays_zip(F.col("r.chosen").alias("child_id"), F.col("r.parents").alias("parent_id"))).alias("pos", "x"))
    return out.select("query_id", F.col("x.child_id").alias("child_id"), F.col("x.parent_id").alias("parent_id"), (F.col("pos") + 1).alias("nth"))


BLOCK_HEAD = len("# Memory\n\n## Retrieved Memory")


def budget_pack(items: DataFrame, group: list[str], order: list[str], line: str, budget: int, key: str, head: int = BLOCK_HEAD) -> DataFrame:
    """(group, used, n_kept, kept): whole items in order while the rendered block, the head and the lines kept so far, stays
    within ``budget`` by the length estimate; what doesn't fit is skipped and the rest goes on. The items of a group are
    the pool of a search, a bounded list."""
    pool = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("_key"), F.length(line).cast("long").alias("_n")))).alias("pool"))
    start = F.struct(F.lit(head).cast("long").alias("chars"), F.array().cast("array<bigint>").alias("kept"))
    cost = lambda n: F.floor(n / 4) + 4
    step = lambda a, x: F.when(cost(a["chars"] + 1 + x["_n"]) <= budget, F.struct((a["chars"] + 1 + x["_n"]).alias("chars"), F.concat(a["kept"], F.array(x["_key"])).alias("kept"))).otherwise(a)
    r = pool.select(*group, F.aggregate("pool", start, step).alias("r"))
    return r.select(*group, F.when(F.size("r.kept") > 0, cost(F.col("r.chars"))).otherwise(F.lit(0)).cast("long").alias("used"), F.size("r.kept").alias("n_kept"), "r.kept")


def fit_request(requests: DataFrame, available: int) -> DataFrame:
    """(query_id, n_facts, children, parents, status, fits) of requests (query_id, core, facts, evidence, status): the last
    facts are dropped until the rest fits, then the last pieces of evidence, with parents that no piece is left of; what
    is core stays, and where that alone is too much nothing fits.

    core is the cost of what must stay, facts an array of costs in order, evidence an array of (child_id, parent_id,
    child_cost, parent_cost) in order. A verdict on the evidence no longer holds once some of it is dropped, and becomes
    insufficient. Null arrays are empty. Both are bounded pools."""
    facts, ev = F.coalesce("facts", F.array().cast("array<bigint>")), F.coalesce("evidence", F.array().cast("array<struct<child_id:bigint,parent_id:bigint,child_cost:bigint,parent_cost:bigint>>"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def upto(j: Column) -> Column:
        kept = F.slice("_ev", F.lit(1), j)
        parents = F.array_distinct(F.transform(kept, lambda x: F.struct(x["parent_id"].alias("p"), x["parent_cost"].alias("c"))))
        return total(F.transform(kept, lambda x: x["child_cost"].cast("long"))) + total(F.transform(parents, lambda x: x["c"].cast("long")))

    r = requests.withColumns({"_facts": facts, "_ev": ev})
    all_ev = upto(F.size("_ev"))
    n = F.array_max(F.filter(F.sequence(F.lit(0), F.size("_facts")), lambda i: F.col("core") + total(F.slice("_facts", F.lit(1), i)) + all_ev <= available))
    m = F.array_max(F.filter(F.sequence(F.lit(0), F.size("_ev")), lambda j: F.col("core") + upto(j) <= available))
    r = r.withColumns({"_n": n, "_m": m})
    r = r.withColumns({"n_facts": F.coalesce("_n", F.lit(0)), "n_children": F.when(F.col("_n").isNotNull(), F.size("_ev")).otherwise(F.coalesce("_m", F.lit(0))), "fits": F.col("_n").isNotNull() | F.col("_m").isNotNull()})
    kept = F.slice("_ev", F.lit(1), F.col("n_children"))
    cut = (F.col("n_children") < F.size("_ev")) & F.col("status").isin("sufficient", "insufficient")
    return r.select("query_id", "n_facts", F.transform(kept, lambda x: x["child_id"]).alias("children"), F.array_distinct(F.transform(kept, lambda x: x["parent_id"])).alias("parents"), F.when(cut, "insufficient").otherwise(F.col("status")).alias("status"), "fits")
