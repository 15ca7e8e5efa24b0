"""Line dedup: exact copies by hash, near copies by a segment-partition edit join (Pass-Join).

A line is a duplicate if an earlier line of the corpus is the same, or reaches it over lines within
``threshold`` edits. Exact copies count from ``min_exact`` characters (1: every line that is not
blank), edits link lines of at least ``min_chars``. (Li et al., "PASS-JOIN", 2011.)

1. A line of length n is split into threshold + 1 segments; two lines within the threshold share
   one of them. Index rows carry the hash of (length, segment number, segment); probe rows carry
   the hashes of the substrings that can match a segment of a line of length n - threshold .. n
   (multi-match-aware start positions). Hashes of all substrings come from one prefix sum over
   the code points, in numpy.
2. One shuffle by that hash. Most hashes belong to one line and vanish there; rows that stream by
   are held in constant memory. A hash that floods a single batch is salted beforehand.
3. Surviving members get their texts (each from one document that holds the line), are dealt to blocks of bounded size, and a task verifies
   each block with the banded bit-parallel edit distance (Hyyro 2003), vectorised over pairs. It
   emits a spanning forest of the links, never all pairs.
4. Components of the links, and the first line of each.
"""

from __future__ import annotations

from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_key
from .graph import components
from .simhash import forest

MULT = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2^64
INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
HOT = 1000  # rows of one hash in one batch from which it is salted
SALTS = 64
CHARS = 1 << 20  # code points signed at once


def line_id(line: str) -> bytes:
    """96-bit hash that stands for the line's text."""
    return xxhash.xxh3_128_digest(line.encode())[:12]


def line_table(docs: DataFrame, min_chars: int, blank: int = 0) -> DataFrame:
    """(doc_id, th, n_lines, line, id) for every line of at least ``min_chars`` characters.

    Lines of white space alone count from ``blank`` characters.
    """
    def run(batches):
        for batch in batches:
            out: tuple = ([], [], [], [])
            for row, text in enumerate(batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and (len(line) >= blank or line.strip()):
                        out[0].append(row)
                        out[1].append(len(lines))
                        out[2].append(i)
                        out[3].append(line_id(line))
            row = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                names=["doc_id", "th", "n_lines", "line", "id"])
    return docs.select("doc_id", text_key().alias("th"), "text").mapInArrow(
        run, "doc_id long, th long, n_lines int, line int, id binary")


# -- signatures --------------------------------------------------------------------------------------

def _mix(h: np.ndarray, length, seg) -> np.ndarray:
    h = h ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seg + 1) << 40))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(n: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the threshold + 1 nearly equal segments of lines of length n."""
    k = threshold + 1
    short, longer = n // k, n % k  # the last n % k segments are one character longer
    out, start = [], np.zeros_like(n)
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((start, size))
        start = start + size
    return out


def signatures(lines: list[str], threshold: int):
    """Yield (line numbers, signed hashes, is_probe) of all rows of ``lines``; an index row is also a probe row."""
    n = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    rel = np.arange(len(codes)) - np.repeat(start, n)
    top = int(n.max(initial=0)) + 1
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(top, x)]) for x in (MULT, INV))
    prefix = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * power[rel])]

    def hashed(who, at, size):
        s = start[who] + at
        return (prefix[s + size] - prefix[s]) * back[at]

    everyone = np.arange(len(lines))
    for i, (at, size) in enumerate(segments(n, threshold)):
        yield everyone, _mix(hashed(everyone, at, size), n, i).view(np.int64), False
    for less in range(threshold + 1):
        length = n - less
        for i, (at, size) in enumerate(segments(length, threshold)):
            # Pass-Join's multi-match-aware window of start positions, i counted from 0.
            low = np.maximum(np.maximum(at - i, at + less - (threshold - i)), 0)
            high = np.minimum(np.minimum(at + i, at + less + (threshold - i)), n - size)
            for step in range(2 * threshold + 1):
                # The segments of a line itself are its index rows, which count as probe rows too.
                who = np.flatnonzero((low + step <= high) & (length > 0) & ((low + step != at) | (less > 0)))
                if len(who):
                    yield who, _mix(hashed(who, low[who] + step, size[who]), length[who], i).view(np.int64), True


def signature_rows(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(sig, hi, lo): a segment's hash and the line that has it, in 24 bytes.

    hi and the upper bits of lo hold the line id; lo's lower 16 bits are kind (0 marker of a salted
    hash, 1 index and probe, 2 probe alone) and salt (0 for most).
    """
    def sliced(texts):
        seen: set = set()  # bounded: repeats within a task need not be signed twice
        part, chars = [], 0
        for text in texts:
            for line in (text or "").split("\n"):
                if len(line) < min_chars:
                    continue
                key = line_id(line)
                if key in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(key)
                part.append((line, key))
                chars += len(line)
                if chars >= CHARS:
                    yield part
                    part, chars = [], 0
        if part:
            yield part

    def run(batches):
        for part in sliced(t for b in batches for t in b.column(0).to_pylist()):
            ids = np.frombuffer(b"".join(k for _, k in part), dtype=np.dtype([("hi", ">i8"), ("lo", ">u4")]))
            got = list(signatures([x for x, _ in part], threshold))
            who = np.concatenate([w for w, _, _ in got])
            sig = np.concatenate([s for _, s, _ in got])
            kind = np.concatenate([np.full(len(w), 1 + p, dtype=np.int64) for w, _, p in got])
            hi, low = ids["hi"].astype(np.int64)[who], ids["lo"].astype(np.int64)[who]
            salt = np.zeros(len(sig), dtype=np.int64)
            bucket = (sig & 0xFFFF).astype(np.int64)  # only hashes in full buckets need to be counted
            uniq, count = np.unique(sig[(np.bincount(bucket, minlength=1 << 16) > HOT)[bucket]], return_counts=True)
            hot = uniq[count > HOT]
            if len(hot):
                flood = np.isin(sig, hot)
                salt[flood] = 1 + low[flood] % SALTS
                none = np.zeros(len(hot), dtype=np.int64)
                sig, hi, low, kind, salt = (np.r_[x, y] for x, y in ((sig, hot), (hi, none), (low, none), (kind, none), (salt, none)))
            table = pa.table([pa.array(sig), pa.array(hi), pa.array((low << 16) | (kind << 8) | salt)], names=["sig", "hi", "lo"])
            yield from table.to_batches(max_chunksize=1 << 16)
    return docs.select("text").mapInArrow(run, "sig long, hi long, lo long")


def live_members(rows: DataFrame) -> DataFrame:
    """(sig, kind, id) of hashes held by an index row and a probe row of different lines.

    kind 0 is an index row, 1 a probe row; a row that is both is returned as two. Rows arrive sorted by (sig, salt, kind, line); one pass in
    constant memory. Salted rows and the rows of a marked hash are always live.
    """
    def run(batches):
        sig = first = None
        live = False
        for batch in batches:
            keep: list[tuple] = []
            s, hi, lo = (batch.column(c).to_numpy() for c in range(3))
            if not len(s):
                continue
            salt, kind = lo & 255, lo >> 8 & 255
            # A hash that appears once in the batch and does not touch its ends needs no look.
            alone = np.r_[False, (s[1:-1] != s[:-2]) & (s[1:-1] != s[2:]), False][:len(s)] & (salt == 0)
            for j in np.flatnonzero(~alone):
                if s[j] != sig:
                    sig, first, live = s[j], None, False
                line = (hi[j], lo[j] >> 16)
                if kind[j] == 0:
                    live = True
                elif salt[j] or live:
                    keep.append((s[j], kind[j], *line))
                elif first is None:
                    if kind[j] == 1:  # without an index row the hash is dead: first stays None
                        first = line
                elif line != first:
                    live = True
                    keep += [(sig, 1, *first), (s[j], kind[j], *line)]
            if keep:
                rows_ = [(s_, k, pack(">qI", int(h), int(low))) for s_, kind_, h, low in keep for k in ((0, 1) if kind_ == 1 else (1,))]
                sigs, kinds, ids = zip(*rows_)
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(kinds, pa.int8()),
                                                  pa.array(ids, pa.binary())], names=["sig", "kind", "id"])
    salt, kind = F.expr("lo & 255"), F.expr("shiftright(lo, 8) & 255")
    return (rows.repartition("sig", salt).sortWithinPartitions("sig", salt, kind, "hi", "lo")
            .mapInArrow(run, "sig long, kind byte, id binary"))


CELLS = 1 << 24  # characters of one side that are compared at once, 4 bytes each

# -- verification ------------------------------------------------------------------------------------

def edit_distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distance of each pair of code point arrays, ``most`` + 1 if larger. Vectorised.

    Pairs are taken by 4,096, or fewer so that their characters fit ``CELLS``; a single longer pair goes alone.

    Banded bit-parallel: a column of the matrix is the 2 * most + 1 cells around the diagonal, held as
    vertical delta bits in the top of a 64-bit word that moves down one row a step (most <= 31).
    """
    pairs = len(a)
    flip = [len(x) < len(y) for x, y in zip(a, b)]
    p = [y if f else x for x, y, f in zip(a, b, flip)]  # the longer one
    t = [x if f else y for x, y, f in zip(a, b, flip)]
    m, n = (np.array([len(x) for x in y], dtype=np.int64) for y in (p, t))
    out = np.full(pairs, most + 1, dtype=np.int64)
    live = np.flatnonzero(m - n <= most)
    live = live[np.argsort(n[live], kind="stable")]
    pad = most + 1
    lo = 0
    while lo < len(live):
        hi = min(lo + 4096, len(live))
        while hi > lo + 1 and (hi - lo) * (m[live[lo:hi]].max() + 2 * pad) > CELLS:
            hi = lo + (hi - lo) // 2
        idx, lo = live[lo:hi], hi
        P = np.zeros((len(idx), int(m[idx].max(initial=0)) + 2 * pad), dtype=np.uint32)
        T = np.zeros((len(idx), int(n[idx].max(initial=0))), dtype=np.uint32)
        for r, k in enumerate(idx):  # 0 stands for "outside"; characters are moved up by one
            P[r, pad:pad + m[k]] = p[k] + 1
            T[r, :n[k]] = t[k] + 1
        out[idx] = _band(P, T, m[idx], n[idx], most, pad)
    return out


def _band(P, T, m, n, most, pad):
    one, top = np.uint64(1), np.uint64(63)
    rows = len(m)
    res = np.full(rows, most + 1, dtype=np.int64)
    who = np.arange(rows)
    # Row m sits at bit 63 - most + (m - column); the cell tracked is the diagonal's end (row = column + most)
    # until that row passes m, then row m itself.
    vp = np.full(rows, ~np.uint64(0) << np.uint64(63 - most))
    vn = np.zeros(rows, dtype=np.uint64)
    dist = np.minimum(m, most)
    done = n == 0
    res[who[done]] = np.where(m[done] <= most, m[done], most + 1)
    keep = ~done
    P, T, m, n, who, vp, vn, dist = (x[keep] for x in (P, T, m, n, who, vp, vn, dist))
    col = 0
    while len(who):
        c = T[:, col]
        eq = np.zeros(len(who), dtype=np.uint64)
        for k in range(2 * most + 1):
            row = col - most + k  # pattern position at bit 63 - 2 * most + k
            if row >= 0:
                eq |= (P[:, min(row + pad, P.shape[1] - 1)] == c).astype(np.uint64) << np.uint64(63 - 2 * most + k)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        last = m - 1 - col + 63 - most  # bit of the pattern's last row in this column
        diag = last >= 63
        at = np.minimum(last, 63).astype(np.uint64)
        dist += np.where(diag, 1 - (d0 >> top).astype(np.int64),
                         ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64))
        down = d0 >> one
        vp = hn | ~(down | hp)
        vn = down & hp
        col += 1
        end = n == col
        if end.any():
            res[who[end]] = np.minimum(dist[end], most + 1)
        # On the diagonal the count only grows; on row m it can fall by one a column.
        lost = dist - (n - np.maximum(col, m - most)) > most
        keep = ~(end | lost)
        if not keep.all() and (keep.sum() < 0.8 * len(keep) or end.any()):
            P, T, m, n, who, vp, vn, dist = (x[keep] for x in (P, T, m, n, who, vp, vn, dist))
    return res


def _verify_block(ids: list[bytes], texts: list[str], kind: np.ndarray, threshold: int, most: int = 1 << 15):
    """Yield forests of verified links between the index (0) and probe (1) members of one block."""
    uniq: dict[bytes, int] = {}
    codes: list[np.ndarray] = []
    at = np.empty(len(ids), dtype=np.int64)
    for i, (k, t) in enumerate(zip(ids, texts)):
        if k not in uniq:
            uniq[k] = len(codes)
            codes.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        at[i] = uniq[k]
    names = list(uniq)
    n = np.array([len(c) for c in codes])
    index, probe = np.unique(at[kind == 0]), np.unique(at[kind == 1])
    asks = np.isin(index, probe)
    for q in probe:
        gap = n[q] - n[index]
        # A pair of equal length that meets here from both sides is compared once.
        twice = asks & (index < q) & bool((index == q).any())
        other = index[(gap > 0) & (gap <= threshold) | (gap == 0) & (index != q) & ~twice]
        for i in range(0, len(other), most):
            yield q, other[i:i + most], codes, names


def places(table: DataFrame) -> DataFrame:
    """(id, p, n): the first place (doc_id, th, line) of each line of a line table, and its number of places."""
    return table.groupBy("id").agg(F.min(F.struct("doc_id", "th", "line")).alias("p"), F.count("*").alias("n"))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the lines ``wanted`` (id, p), each read where ``p`` says."""
    per_doc = (wanted.groupBy(F.col("p.doc_id").alias("__id"), F.col("p.th").alias("__key"))
               .agg(F.collect_list(F.struct("p.line", "id")).alias("w")))
    one = F.coalesce("text", F.lit("")).alias("text")

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.split("\n")
                for x in lines:
                    if x["line"] < len(text):
                        ids.append(x["id"])
                        out.append(text[x["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["id", "line"])
    joined = docs.select("doc_id", one, text_key().alias("th")).join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__key")))
    # A repeated row gives its lines again.
    return joined.select("text", "w").mapInArrow(run, "id binary, line string").groupBy("id").agg(F.first("line").alias("line"))


def links(docs: DataFrame, threshold: int = 2, min_chars: int = 20, block: int = 512, first: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of line ids that connect exactly the different lines within ``threshold`` edits.

    ``first``: what :func:`places` says of the lines, if the caller has it.
    """
    members = staged(live_members(signature_rows(docs, threshold, min_chars)).distinct(), "members")
    size = members.groupBy("sig").agg(F.ceil(F.sum(F.expr("int(kind = 0)")) / block).cast("int").alias("ni"),
                                      F.ceil(F.sum(F.expr("int(kind = 1)")) / block).cast("int").alias("nq"))
    size = size.where("ni > 0 AND nq > 0")
    spread = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("ni")).otherwise(F.col("nq"))).cast("int")
    dealt = (members.join(size, "sig").withColumn("own", spread)
             .withColumn("other", F.explode(F.expr("sequence(0, if(kind = 0, nq, ni) - 1)")))
             .select("id", "kind", F.expr("struct(sig, if(kind = 0, own, other) AS i, if(kind = 0, other, own) AS q)").alias("g")))
    needed = members.select("id").distinct()

    if first is None:
        first = places(line_table(docs, min_chars))
    texts = staged(line_texts(docs, first.join(needed, "id", "left_semi")), "lines")

    def verify(batches):
        def flush(todo):
            a = [c for q, o, codes, _ in todo for c in [codes[q]] * len(o)]
            b = [codes[x] for q, o, codes, _ in todo for x in o]
            ok = edit_distances(a, b, threshold) <= threshold
            left = [names[q] for q, o, _, names in todo for _ in o]
            right = [names[x] for _, o, _, names in todo for x in o]
            pairs = [(x, y) for x, y, good in zip(left, right, ok) if good]
            if pairs:
                number = {x: i for i, x in enumerate(sorted({x for pair in pairs for x in pair}))}
                nodes = list(number)
                u, v = forest(*(np.array([number[pair[k]] for pair in pairs]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in u], pa.binary()),
                                                  pa.array([nodes[i] for i in v], pa.binary())], names=["a", "b"])

        todo, count = [], 0
        for ids, texts_, kind in _blocks(batches):
            for item in _verify_block(ids, texts_, kind, threshold):
                if len(item[1]):
                    todo.append(item)
                    count += len(item[1])
                    if count >= 1 << 15:
                        yield from flush(todo)
                        todo, count = [], 0
        if todo:
            yield from flush(todo)

    flat = dealt.join(texts, "id").select("g.sig", "g.i", "g.q", "kind", "id", "line")
    return (flat.repartition("sig", "i", "q").sortWithinPartitions("sig", "i", "q")
            .mapInArrow(verify, "a binary, b binary").distinct())


def _blocks(batches):
    """Rows of one (sig, i, q) at a time; a block has at most a few thousand rows by construction."""
    key, ids, texts, kinds = None, [], [], []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in range(6)))
        for s, i, q, kind, id_, line in rows:
            if (s, i, q) != key:
                if ids:
                    yield ids, texts, np.array(kinds)
                key, ids, texts, kinds = (s, i, q), [], [], []
            ids.append(id_)
            texts.append(line)
            kinds.append(kind)
    if ids:
        yield ids, texts, np.array(kinds)


def duplicate_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 20, min_exact: int | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): (doc_id, th, n_lines, n_removed, removed, classes).

    ``removed`` lists the numbers (from 0) of lines that are not the first of their class, in line
    order, and ``classes`` the doc_id that holds each one's first. "First" is by (doc_id, text hash,
    line number), null ids first. Lines shorter than ``min_chars`` characters do not link; they are
    duplicates only of the same line, if they have ``min_exact`` characters (``min_chars`` if None) and
    are not blank. Null or empty text: one empty line, none removed. Rows that repeat doc_id and
    text are one document. Empty table: no rows.
    """
    table = staged(line_table(docs, min_chars if min_exact is None else min_exact, min_chars), "linetable")
    place = F.struct("doc_id", "th", "line")
    first = staged(places(table), "places")
    joined = components(links(docs, threshold, min_chars, first=first))
    first = first.join(joined, first.id == joined.node, "left").select("id", "p", "n", "root")
    linked = first.where("root IS NOT NULL")
    lead = linked.groupBy("root").agg(F.min("p").alias("lead"))
    # Only ids that are repeated or linked can lose lines.
    keeper = staged(linked.join(lead, "root").select("id", "lead")
                    .union(first.where("root IS NULL AND n > 1").select("id", F.col("p").alias("lead"))), "keepers")
    lost = (table.join(keeper, "id").where(~place.eqNullSafe(F.col("lead")))
            .select("doc_id", "th", "line", F.col("lead.doc_id").alias("of")).distinct())
    per_doc = lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("line", "of"))).alias("r"))
    per_doc = per_doc.select(F.col("doc_id").alias("__id"), F.col("th").alias("__key"), F.col("r.line").alias("removed"),
                             F.col("r.of").alias("classes"))
    text = F.coalesce("text", F.lit(""))
    all_docs = docs.select("doc_id", text_key().alias("th"),
                           (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n_lines")).distinct()
    return (all_docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__key")), "left")
            .select("doc_id", "th", F.col("n_lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("removed", F.expr("cast(array() AS array<int>)")).alias("removed"),
                    F.coalesce("classes", F.expr("cast(array() AS array<bigint>)")).alias("classes")))


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 20, least_kept: float = 0.0,
                min_exact: int = 1) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text`` (columns as before; ``n_chars`` follows).

    Only lines go, and a document of which no visible character is left. A ``least_kept`` above 0 also
    drops documents that keep less than that share of their characters, lines of their own included.
    Rows without duplicate lines come back unchanged, nulls included.
    """
    found = duplicate_lines(docs, threshold, min_chars, min_exact).where("n_removed > 0").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__key"), F.col("removed").alias("__removed"))
    found = staged(found, "removed")
    joined = docs.withColumn("__th", text_key()).join(
        found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__key")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(__removed, i)), '\\n')")
    joined = joined.withColumn("__text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
    joined = joined.where(F.col("__removed").isNull() | (
        F.col("__text").rlike(r"\S") & (F.length("__text") >= least_kept * F.length("text"))))
    changed = F.col("__removed").isNotNull()
    cols = {"text": F.col("__text").alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return joined.select(*[cols.get(c, F.col(f"`{c}`")) for c in docs.columns])
