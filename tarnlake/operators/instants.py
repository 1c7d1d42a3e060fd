"""Mixed timestamp formats and zones to one UTC instant, by expectation-maximisation over the interpretations of each source.

A source is a mixture of components: its declared format, a full date and time with offset, and an epoch number (one component
per unit). Within the declared format a time may have several readings: the two instants of a repeated wall time, and the years
of a time without year. How often a source means the later instant or an earlier year is estimated with the weights, from the
values that have the choice. A value that none of these parses, because its source declares no format or another one, may still be a date and time whose order
of year, month and day its source tells: the orders are components too, and a source's unambiguous days decide for the others.

A reading that does not parse has likelihood 0. One that does has likelihood 1 per second of its window (2000 to 2049 for all
components, so the window cancels; the earlier years of a time share theirs), times 1 / (1 + d) for its distance d in minutes from
what ingest stored and 1 / (1 + d) for its distance d in months of 30 days before the source's close, or ``AFTER_CLOSE`` if it
comes after that. Both tails are long, for stored times may be another line's.

EM estimates each source's weights from all of its values; the posterior picks the component. The instant given is that of the
component by the rules of ``strptime.instant`` (earlier instant, latest year), whatever the posterior of its other readings;
``likely_us`` is the most likely instant, ``likely_as`` its reading. Where the components stay within ``margin`` of each other the declared format holds. Where the
instant given does not lead every other by ``margin`` the value is marked ambiguous.

Likelihoods are rounded to powers of two, relative to the value's best, so the statistics of EM are sums per (source, pattern of
levels): a source holding a third of all values is summed map-side, and its weights are fitted on its patterns, whose number does
not grow with its values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strptime as S
from ..session import cut, salted_lookup

UNITS = (1, 1_000, 1_000_000, 1_000_000_000)
#: Weights of a source: declared, iso and an epoch number by unit; and how often its times mean the later instant or an earlier year.
COMPONENTS = ("declared", "iso", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns", *S.ORDERS)
CHOICES = ("later", "year")
#: Readings of a value, the declared format's first; a rule's reading stands before its rivals. Orders are tried where there is no other.
RULED = ("declared", "later", "year", "iso", "epoch")
READINGS = (*RULED, *S.ORDERS)
#: Likelihoods below 2^-LEVELS of the value's best count as that.
LEVELS = 16
AFTER_CLOSE = 1 / 1024
MINUTE, MONTH = 60_000_000, 30 * 86_400_000_000
SCHEMA = ", ".join(["stamp_id long, file_id long, unit int", *[f"i_{k} long" for k in READINGS], "i_stored long, levels array<int>"])
RESULT = "stamp_id long, file_id long, utc_us long, interpretation string, posterior double, ambiguous boolean, likely_us long, likely_as string"
WEIGHTS = ", ".join(["file_id long", *[f"w_{k} double" for k in COMPONENTS + CHOICES]])


def likelihood(us: int, closed: int | None, stored: int | None) -> float:
    out = 1.0
    if stored is not None:
        out /= 1 + abs(us - stored) / MINUTE
    if closed is not None:
        out *= AFTER_CLOSE if us > closed else 1 / (1 + (closed - us) / MONTH)
    return out


def levels_of(found: list[float | None]) -> list[int | None]:
    best = max((x for x in found if x is not None), default=None)
    return [None if x is None else min(LEVELS, round(math.log2(best / x))) for x in found]


def inferred(text: str, zone: str | None, closed: int | None) -> list[int | None]:
    """The instants of a text in each order of ORDERS."""
    m = S.FREE.fullmatch(text)
    if m is None:
        return [None] * len(S.ORDERS)
    fields = [S.ordered_fields(m, o) for o in S.ORDERS]
    return [S.of_fields(f, zone, closed)[0] if f else None for f in fields]


def interpretations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_order = [None] * len(S.ORDERS)
    for batch in batches:
        col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows = []
        for text, fmt, zone, closed, stored in zip(col["prefix_text"], col["prefix_format"], col["zone_name"], col["closed_us"], col["epoch_ts"]):
            text = text.strip() if text is not None else ""
            declared = later = year = iso = epoch = unit = None
            years: tuple[int, ...] = ()
            orders = no_order
            stored = S.number_to_us(stored) if stored is not None else None
            if text:
                pattern = S.compile_format(fmt) if fmt else None
                if pattern is not None and (m := pattern.fullmatch(text)):
                    declared, later, years = S.readings(m, zone, closed)
                if text[0].isdigit():
                    if text[4:5] == "-" and (m := S.ISO.fullmatch(text)):
                        iso = S.instant(m, zone, closed)
                    elif m := S.EPOCH.fullmatch(text):
                        number = int(m["s"]) if len(m["s"]) <= 20 else 0
                        epoch = S.number_to_us(number, m["f"])
                        unit = next((i for i, u in enumerate(UNITS) if S.LOW * u <= number < S.HIGH * u), None)
                if declared is None and iso is None and epoch is None and ":" in text:
                    orders = inferred(text, zone, closed)
            if later is not None or years or orders is not no_order or (declared is not None) + (iso is not None) + (epoch is not None) > 1:
                each = [likelihood(y, closed, stored) for y in years]
                year = years[each.index(max(each))] if years else None
                found = [None if us is None else likelihood(us, closed, stored) for us in (declared, later, year, iso, epoch, *orders)]
                found[2] = sum(each) / len(each) if years else None
                levels = levels_of(found)
            else:
                levels = [None if us is None else 0 for us in (declared, later, year, iso, epoch, *orders)]
            rows.append((unit, declared, later, year, iso, epoch, *orders, stored, levels))
        names = ["unit", *[f"i_{k}" for k in READINGS], "i_stored", "levels"]
        kinds = {"unit": pa.int32(), "levels": pa.list_(pa.int32())}
        arrays = [batch.column(batch.schema.get_field_index(n)).cast(pa.int64()) for n in ("stamp_id", "file_id")]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, cols)]], ["stamp_id", "file_id", *names])


def priors(levels, unit, w: dict) -> list:
    """Weight times likelihood of each reading of READINGS, without regard to a common factor; works on numbers."""
    declared, later, year, iso, epoch, *orders = [0.0 if v is None else 2.0**-v for v in levels]
    among = w["later"] if levels[1] is not None else 0.0
    before = w["year"] if levels[2] is not None else 0.0
    of = w["declared"]
    ruled = [of * (1 - before) * (1 - among) * declared, of * (1 - before) * among * later, of * before * year, w["iso"] * iso, (w[COMPONENTS[2 + unit]] if unit is not None else 0.0) * epoch]
    return ruled + [w[o] * x for o, x in zip(S.ORDERS, orders)]


def em(patterns: list[tuple[int | None, list, int]], rounds: int) -> dict[str, float]:
    """The weights of one source from its patterns (unit, levels, n)."""
    w = {k: 1.0 / len(COMPONENTS) for k in COMPONENTS} | {k: 0.5 for k in CHOICES}
    total = float(sum(n for *_, n in patterns))
    if all(sum(v is not None for v in levels) < 2 for _, levels, _ in patterns):
        rounds = 1  # nothing to share out: the first round is the last
    for _ in range(rounds):
        share = {k: 0.0 for k in COMPONENTS}
        # One pseudo-count on the declared format: it wins where nothing in the data speaks against it. One on each side of a choice.
        share["declared"] = 1.0
        taken, asked = {k: 1.0 for k in CHOICES}, {k: 2.0 for k in CHOICES}
        for unit, levels, n in patterns:
            p = priors(levels, unit, w)
            mass = sum(p) + 1e-12
            p = [n * x / mass for x in p]
            share["declared"] += p[0] + p[1] + p[2]
            share["iso"] += p[3]
            if unit is not None:
                share[COMPONENTS[2 + unit]] += p[4]
            for o, x in zip(S.ORDERS, p[len(RULED) :]):
                share[o] += x
            if levels[1] is not None:
                taken["later"] += p[1]
                asked["later"] += p[0] + p[1]
            if levels[2] is not None:
                taken["year"] += p[2]
                asked["year"] += p[0] + p[1] + p[2]
        w = {k: v / (total + 1.0) for k, v in share.items()} | {k: taken[k] / asked[k] for k in CHOICES}
    return w


def fit_weights(counts: DataFrame, rounds: int = 12) -> DataFrame:
    """EM per source over (file_id, unit, levels, n). One row per source with its weights."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = batch.column(0), []
            for patterns in batch.column(1).to_pylist():
                w = em([(p["unit"], p["levels"], p["n"]) for p in patterns], rounds)
                cols.append([w[k] for k in COMPONENTS + CHOICES])
            arrays = [pa.array([r[i] for r in cols], pa.float64()) for i in range(len(COMPONENTS + CHOICES))]
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["file_id", *[f"w_{k}" for k in COMPONENTS + CHOICES]])

    # Sorted, so that the sums come out the same each time.
    per = counts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("unit", "levels", "n"))).alias("patterns"))
    return per.mapInArrow(fit, WEIGHTS)


def choose(instants: list[int | None], levels: list[int | None], unit: int | None, stored: int | None, w: dict, margin: float) -> tuple[int | None, str, float, bool, int, str]:
    """(instant given, its component, its posterior, ambiguous, most likely instant, its reading) of a value with two readings or more, or with readings by order alone."""
    p = priors(levels, unit, w)
    mass = sum(p) or 1.0
    p = [x / mass for x in p]
    first = lambda us: next(k for k, x in zip(READINGS, instants) if x == us)
    if all(us is None for us in instants[: len(RULED)]):  # the rules give the stored time; EM tells what the text says
        ranked = sorted(((x, us) for us, x in zip(instants, p) if us is not None), reverse=True)
        lead = ranked[0][0] - next((x for x, us in ranked if us != ranked[0][1]), -1.0)
        return stored, "none" if stored is None else "stored", ranked[0][0], lead < margin, ranked[0][1], first(ranked[0][1])
    options = [(sum(p[:3]), "declared", instants[0]), (p[3], "iso", instants[3]), (p[4], "epoch", instants[4])]
    options = sorted((o for o in options if o[2] is not None), key=lambda o: -o[0])  # ties go to the declared format
    given = options[0]
    rival = next((o for o in options if o[2] != given[2]), None)
    if rival is not None and given[0] - rival[0] < margin and instants[0] is not None:
        given = (0.0, "declared", instants[0])
    # Readings that agree on the instant add up.
    by: dict[int, float] = {}
    for us, x in zip(instants, p):
        if us is not None:
            by[us] = by.get(us, 0.0) + x
    lead = by[given[2]] - max((x for us, x in by.items() if us != given[2]), default=-1.0)
    likely = max(by, key=by.get)
    return given[2], given[1], by[given[2]], lead < margin, likely, first(likely)


def choices(batches: Iterator[pa.RecordBatch], margin: float) -> Iterator[pa.RecordBatch]:
    """The result of the values that leave something to choose."""
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.string())
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            w = {k: r[f"w_{k}"] for k in COMPONENTS + CHOICES}
            rows.append(choose([r[f"i_{k}"] for k in READINGS], r["levels"], r["unit"], r["i_stored"], w, margin))
        ids = [batch.column(batch.schema.get_field_index(n)) for n in ("stamp_id", "file_id")]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)


def settled(parsed: DataFrame) -> DataFrame:
    """The result of the values with one reading or none, for which the weights do not matter."""
    us = F.coalesce(*[F.col(f"i_{k}") for k in ("declared", "iso", "epoch", "stored")])
    name = F.lit("none")
    for k in ("stored", "epoch", "iso", "declared"):
        name = F.when(F.col(f"i_{k}").isNotNull(), F.lit(k)).otherwise(name)
    sure = F.when(F.coalesce("i_declared", "i_iso", "i_epoch").isNotNull(), 1.0).otherwise(0.0)
    return parsed.select("stamp_id", "file_id", us.alias("utc_us"), name.alias("interpretation"), sure.alias("posterior"), F.lit(False).alias("ambiguous"), us.alias("likely_us"), name.alias("likely_as"))


def normalise_instants(stamps: DataFrame, files: DataFrame, margin: float = 0.2, rounds: int = 12) -> DataFrame:
    """One row per stamp_id: utc_us (null: none), interpretation (declared, iso, epoch, stored or none), posterior, ambiguous, likely_us, likely_as.

    The stored epoch_ts gives the instant only where prefix_text gives none. Null texts, formats, zones (UTC), close times and unknown files are
    allowed; rows with a null stamp_id are left out, repeated rows (equal in every column) count once. The posterior is that of the instant given, and likely_us the instant of the
    highest posterior; for a value that only an order of year, month and day explains the posterior is that of the most likely order. A value is ambiguous if its instant does not lead that of every other reading by ``margin``.
    """
    stamps = stamps.select("stamp_id", "file_id", "prefix_text", "epoch_ts").where("stamp_id is not null").distinct()
    files = files.where("file_id is not null").select("file_id", "prefix_format", "zone_name", F.unix_micros("closed_at").alias("closed_us")).dropDuplicates(["file_id"])
    joined = salted_lookup(stamps, files, ["file_id"], F.col("stamp_id"))
    parsed = cut(joined.mapInArrow(interpretations, SCHEMA))
    counts = parsed.groupBy("file_id", "unit", "levels").agg(F.count("*").alias("n"))
    open_ = F.size(F.array_compact("levels")) > 1
    open_ = open_ | F.coalesce(*[f"i_{o}" for o in S.ORDERS]).isNotNull()
    weighted = salted_lookup(parsed.where(open_), cut(fit_weights(counts, rounds)), ["file_id"], F.col("stamp_id"))
    return settled(parsed.where(~open_)).unionByName(weighted.mapInArrow(lambda batches: choices(batches, margin), RESULT))
