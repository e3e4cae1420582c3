"""Reports in Markdown: every table is collected after it was cut to its largest rows.

A section is a list of blocks, pieces of text that a blank line separates. A
table is described by its columns: a title, what a row shows there, and
whether numbers line up on the right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.systemwide import OUTCOMES
from ..sources.files import delete, moved, names_in

#: Titles that readers of these reports look for.
HEADLINE, COMPARISON, NOTES = "Headline Numbers", "Scenario Comparison", "Notes on Reading These Tables"
FOLD = "<details>\n<summary>{title}</summary>\n\n{body}\n\n</details>"


class Col(NamedTuple):
    title: str
    show: Callable[[Any], str]
    right: bool = False


def grid(columns: Iterable[Col], rows: Iterable) -> str:
    """A table as text, one line a row; an empty cell has a single blank."""
    columns = list(columns)
    lines = [[c.title for c in columns], ["---:" if c.right else "---" for c in columns]]
    lines += [[c.show(r) for c in columns] for r in rows]
    return "\n".join(" ".join(["|", *(piece for cell in line for piece in ((cell, "|") if cell else ("|",)))]) for line in lines)


def ranked(rows: Iterable) -> list[tuple[int, Any]]:
    """Rows with their place, from 1."""
    return list(enumerate(rows, 1))


def whole(x: float) -> str:
    return f"{x:,.0f}"


def signed(x: float) -> str:
    return f"{x:+,.0f}" if round(x) else "0"


def share(x: float, total: float, digits: int = 1) -> str:
    return f"{100 * x / total if total else float('nan'):.{digits}f}%"


def share_or_zero(x: float, total: float, digits: int = 1) -> str:
    return f"{100 * x / total if total else 0.0:.{digits}f}%"


def both(x: float, total: float, of: Callable = share) -> str:
    """A number and its share."""
    return f"{whole(x)} ({of(x, total)})"


def document(title: str, intro: str, command: str, sections: list[list[str]]) -> str:
    """The whole report: its sections, with a rule above each."""
    blocks = [f"# {title}", intro, f"Produced by `{command}`."]
    for section in sections:
        blocks += ["---", *section]
    return "\n\n".join(blocks) + "\n"


#: Flows of the regional report and the columns of their sums.
FLOWS = {"Outside→Inside": "out_in", "Inside→Outside": "in_out", "Inside→Inside": "in_in", "Outside→Outside": "out_out", "**Inter**": "inter", "**Intra**": "intra"}


def regional(totals: Row, pairs: list[Row], day_label: str, top_n: int) -> list[str]:
    flows = [Col("Flow", lambda f: f[0]), Col("Riders", lambda f: whole(totals[f[1]])), Col("% Total", lambda f: share(totals[f[1]], totals.total))]
    top = [
        Col("#", lambda r: str(r[0])), Col("Riders", lambda r: whole(r[1].riders)), Col("% Total", lambda r: share(r[1].riders, totals.total, 2)), Col("Flow", lambda r: r[1].flow),
        Col("Origin→Destination", lambda r: f"{r[1].origin_name}→{r[1].dest_name}"),
    ]
    return [f"## {HEADLINE}", f"Total: {whole(totals.total)} riders/{day_label}", grid(flows, FLOWS.items()), f"## Top {top_n} Origin/Destination Pairs", grid(top, ranked(pairs))]


def regional_summary(totals: Row, day_label: str) -> str:
    return "\n".join([f"total={whole(totals.total)} riders/{day_label}", *(f"  {name.strip('*')}: {both(totals[c], totals.total)}" for name, c in FLOWS.items())])


def corridor_comparison(totals: list[Row], labels: dict[str, str], day_label: str) -> list[str]:
    order = list(labels)
    columns = [
        Col("Scenario", lambda t: labels[t.scenario]), Col("Total Riders", lambda t: whole(t.total)), Col("Direct 1-Seat", lambda t: both(t.one_seat, t.total)),
        Col("Close 1-Seat", lambda t: both(t.close, t.xfer)), Col("Effective 1-Seat", lambda t: both(t.effective, t.total)),
    ]
    said = f"The {whole(totals[0].total if totals else 0)} riders/{day_label} are the same in every scenario; how many of them need no transfer changes."
    return [f"## {COMPARISON}", said, grid(columns, sorted(totals, key=lambda t: order.index(t.scenario)))]


def corridor_headline(total: Row, day_label: str, close_m: float) -> list[str]:
    """The numbers of a report with one scenario, which has no comparison to show them."""
    lines = [f"- **Total: {whole(total.total)} riders/{day_label}**"]
    if total.total:
        lines.append(f"- **One-seat rides: {share(total.one_seat, total.total)}** ({whole(total.one_seat)}/{day_label})")
    if total.xfer:
        lines.append(f"- **Close one-seat rides: {share(total.close, total.xfer)}** of the riders with a transfer ({whole(total.close)} of {whole(total.xfer)}) end within {close_m:.0f}m of a station on their origin's routes")
    if total.total:
        lines.append(f"- **Effective one-seat rides: {share(total.effective, total.total)}** ({whole(total.effective)}/{day_label}), direct and close ones together")
    return ["\n".join(lines)]


def corridor_summary(totals: list[Row], dests: dict[str, list[Row]], labels: dict[str, str], day_label: str) -> str:
    """What the command says: every scenario's numbers and its destinations, the busiest first."""
    lines = []
    for t in totals:
        lines.append(f"{labels[t.scenario]}: total={whole(t.total)}/{day_label} one-seat={both(t.one_seat, t.total)} close={both(t.close, t.xfer)} effective={both(t.effective, t.total)}")
        lines += [f"  {d.name:<55} total={whole(d.total):>9}  one-seat={d.one_seat_pct:5.1f}%" for d in dests[t.scenario]]
    return "\n".join(lines)


def corridor(total: Row, pairs: list[Row], dests: list[Row], label: str, top_n: int, headline: list[str] | None = None) -> list[str]:
    """A scenario's section; with ``headline`` it is the only one and has no title of its own."""
    sub = "###" if headline is None else "##"
    blocks = [f"## {label}"] if headline is None else [f"## {HEADLINE}", *headline]
    top = [
        Col("#", lambda r: str(r[0])), Col("Riders", lambda r: whole(r[1].riders)), Col("% Total", lambda r: share(r[1].riders, total.total, 2)),
        Col("% 1-Seat", lambda r: share(r[1].riders, total.one_seat, 2) if r[1].one_seat and total.one_seat else ""), Col("Type", lambda r: "1-seat" if r[1].one_seat else "xfer"),
        Col("Close?", lambda r: "close" if r[1].close else "far"), Col("Dist", lambda r: f"{r[1].dist_m or 0:.0f}m"),
        Col("Origin→Destination", lambda r: f"{r[1].origin_name}→{r[1].dest_name}"), Col("1-Seat Destination", lambda r: r[1].near_station or ""),
    ]
    ends = [
        Col("Riders", lambda d: whole(d.total)), Col("1-Seat %", lambda d: f"{d.one_seat_pct:.1f}%"), Col("% All 1-Seat", lambda d: share(d.one_seat, total.one_seat, 2)),
        Col("Close?", lambda d: "" if d.xfer_close_pct is None else f"{d.xfer_close_pct:.0f}%"), Col("Dist", lambda d: "" if d.xfer_dist_m is None else f"{d.xfer_dist_m:.0f}m"),
        Col("Destination", lambda d: d.name),
    ]
    return [
        *blocks, f"{sub} Top {top_n} Origin/Destination Pairs", grid(top, ranked(pairs)), f"{sub} Top {top_n} Destination Stations, Summed across All Origins",
        f"In the order of their riders without a transfer, {whole(total.one_seat)} in all.", grid(ends, dests),
    ]


def corridor_notes(close_m: float) -> list[str]:
    return [f"## {NOTES}", "\n".join([
        f'- "Close?" and "Dist" say how far the destination is from the nearest station on the origin\'s routes in this scenario; up to {close_m:.0f}m are close. Rows with a direct ride have 0m, as a destination is a whole complex in the data.',
        '- "1-Seat Destination" is that nearest station.',
        '- "% 1-Seat" is of the scenario\'s riders without a transfer, "% Total" of all.',
    ])]


LEVELS = {"Direct 1-Seat": "one_seat", "Close 1-Seat": "close", "Effective 1-Seat": "effective"}


def levels(stats: list[Row], order: list[str]) -> str:
    """One line a scenario, with differences to the first."""
    by = {s.scenario: s for s in stats}
    base = by[order[0]]
    part = lambda s, c: s[c] / s.total if s.total else 0
    change = lambda s, c: "" if s is base else f"{signed(s[c] - base[c])} ({100 * (part(s, c) - part(base, c)):+.1f}%)"
    columns = [Col("Scenario", lambda s: s.scenario), Col("Total Riders", lambda s: whole(s.total), True)]
    for title, c in LEVELS.items():
        columns += [Col(title, lambda s, c=c: both(s[c], s.total, share_or_zero), True), Col("Δ", lambda s, c=c: change(s, c), True)]
    return grid(columns, [by[n] for n in order])


def levels_summary(parts: dict[str, list[Row]], gains: Iterable[Row], baseline: str) -> str:
    """What the command says: the levels of every scenario in either scope, and what changes."""
    lines = []
    for title, stats in parts.items():
        lines += [title, *(f"  {s.scenario:<55} total={whole(s.total)} " + " ".join(f"{c}={both(s[c], s.total, share_or_zero)}" for c in LEVELS.values()) for s in stats)]
    gains = list(gains)
    if gains:
        lines += [f"Effective one-seat against {baseline}", *(f"  {g.scenario:<55} gained={whole(g.gained)} lost={whole(g.lost)} net={signed(g.net)}" for g in gains)]
    return "\n".join(lines)


def levels_headline(own: Row, wider: Row, close_m: float) -> list[str]:
    """The numbers of a report with one scenario."""
    lines = [f"- Total: {whole(own.total)} riders", f"- One-seat: {both(own.one_seat, own.total, share_or_zero)}", f"- Close one-seat: {both(own.close, own.total, share_or_zero)}, after a walk of up to {close_m:.0f}m",
             f"- Effective one-seat: {both(own.effective, own.total, share_or_zero)}", f"- Either end on the routes: {whole(wider.total)} riders, {share_or_zero(wider.effective, wider.total)} effective one-seat"]
    return [f"## {HEADLINE}", "\n".join(lines)]


def walk_cells(p: Row) -> tuple[str, str]:
    if p.outcome == "direct" or p.dist_m is None:
        return "", ""
    return f"{p.dist_m:.0f}m", f"{'origin' if p.at_origin else 'dest'}: {p.walk_station}"


def scenario_tables(pairs: list[Row], origins: list[Row], dests: list[Row], total: float) -> list[str]:
    top = [
        Col("#", lambda r: str(r[0]), True), Col("Riders", lambda r: whole(r[1].riders), True), Col("% Total", lambda r: share_or_zero(r[1].riders, total, 2), True),
        Col("Type", lambda r: "1-seat" if r[1].outcome == "direct" else "xfer"), Col("Close?", lambda r: "" if r[1].outcome == "direct" else r[1].outcome),
        Col("Dist", lambda r: walk_cells(r[1])[0], True), Col("Walk", lambda r: walk_cells(r[1])[1]), Col("Origin ↔ Destination", lambda r: f"{r[1].origin_name} ↔ {r[1].dest_name}"),
    ]
    folded = lambda n, body: FOLD.format(title=f"Show {n} rows", body=body)
    blocks = [f"### Top {len(pairs)} Origin/Destination Pairs", folded(len(pairs), grid(top, ranked(pairs)))]
    for title, stats in (("Origin", origins), ("Destination", dests)):
        columns = [
            Col("Riders", lambda s: whole(s.total), True), Col("Direct %", lambda s: share_or_zero(s.one_seat, s.total), True),
            Col("Effective %", lambda s: share_or_zero(s.effective, s.total), True), Col(title, lambda s: s.name),
        ]
        blocks += [f"### Top {len(stats)} {title} Stations", folded(len(stats), grid(columns, stats))]
    return blocks


def transitions(cells: list[Row], gains: Row | None, changes: list[Row], stations: list[Row], baseline: str, total: float) -> list[str]:
    riders = {(c.before, c.after): c.riders for c in cells}
    matrix = [Col("Riders", lambda b: f"**was {b}**"), *(Col(f"now {a}", lambda b, a=a: both(riders.get((b, a), 0.0), total, share_or_zero), True) for a in OUTCOMES)]
    value = {name: gains[name] if gains else 0.0 for name in ("gained", "lost", "net")}
    moved = [Col("#", lambda c: str(c.place), True), Col("Riders", lambda c: whole(c.riders), True), Col("Was", lambda c: c.before), Col("Now", lambda c: c.after), Col("Origin ↔ Destination", lambda c: c.label)]
    by_station = [Col("#", lambda r: str(r[0]), True), Col("Net", lambda r: signed(r[1].net), True), Col("Riders", lambda r: whole(r[1].total), True), Col("Station", lambda r: r[1].name)]
    return [
        f"### What Changed, against {baseline}", grid(matrix, OUTCOMES), "\n".join(f"- {n.capitalize()}: {both(v, total, share_or_zero)}" for n, v in value.items()),
        f"### Biggest Changes, against {baseline}", grid(moved, changes), f"### Biggest Changes by Station, against {baseline}", grid(by_station, ranked(stations)),
    ]


def largest(df: DataFrame, n: int, *order) -> list[Row]:
    """The first ``n`` rows in an order: the only rows that leave the cluster."""
    return df.orderBy(*order).limit(n).collect()


def flattened(df: DataFrame) -> DataFrame:
    """Fields of structs, however deep, as columns of their own with the names of what they are in before theirs; arrays as comma-separated text."""

    def columns(fields, inside: Column | None, prefix: str) -> list[Column]:
        out = []
        for f in fields:
            here = F.col(f"`{f.name}`") if inside is None else inside.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                out += columns(f.dataType, here, f"{prefix}{f.name}_")
            else:
                out.append((F.array_join(here.cast("array<string>"), ",") if isinstance(f.dataType, T.ArrayType) else here).alias(prefix + f.name))
        return out

    chosen = columns(df.schema, None, "")
    flat = df.select(*chosen)
    if len(set(flat.columns)) < len(flat.columns):
        raise ValueError(f"columns clash once structs are flattened: {flat.columns}")
    return flat


def csv_of(df: DataFrame, path: str) -> None:
    """All rows as one CSV file with a header: an executor writes it beside ``path``, then it is moved there."""
    spark, draft = df.sparkSession, f"{path}.parts"
    flattened(df).repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(draft)
    part = next(n for n in names_in(spark, draft) if n.startswith("part-"))
    moved(spark, f"{draft}/{part}", path)
    delete(spark, draft)
