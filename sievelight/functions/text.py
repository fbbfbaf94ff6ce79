"""Words about verdicts: region names, sentences, the location guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the thirds of a grid, and the words that name a side.
REGIONS = (("upper-left", "top", "upper-right"), ("left", "centre", "right"), ("lower-left", "bottom", "lower-right"))
SIDES = {
    "top": ("top", "upper", "above", "topmost", "uppermost"),
    "bottom": ("bottom", "lower", "below", "bottommost", "lowermost"),
    "left": ("left", "leftmost"),
    "right": ("right", "rightmost"),
    "centre": ("centre", "center", "middle", "central", "centred", "centered"),
}
MAX_WORDS = 25


def third(i: Column, n: Column | int) -> Column:
    """0, 1 or 2: the third of an axis of n cells that the centre of cell i lies in."""
    return F.least(F.lit(2), F.floor((6 * i + 3) / (2 * n if isinstance(n, int) else n * 2))).cast("int")


def region(r: Column, c: Column, gh: int, gw: int) -> Column:
    names = F.array(*(F.lit(x) for row in REGIONS for x in row))
    return F.element_at(names, third(r, gh) * 3 + third(c, gw) + 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def clipped(text: Column) -> Column:
    """The first sentence, and of that MAX_WORDS words at most."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentence = F.regexp_extract(flat, r"^[^.!?]*[.!?]?", 0)
    w = words(sentence)
    short = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, MAX_WORDS), " "), "[,;:]+$", ""), F.lit("."))
    return F.when(F.size(w) > MAX_WORDS, short).otherwise(sentence)


def guarded(text: Column, region_name: Column) -> Column:
    """The first word that contradicts the region, or null. A side must be the region's own; the centre goes with the centre region,
    and with an edge that the text names too. Without a region no such word is allowed."""
    side = F.create_map(*(F.lit(x) for s, ws in SIDES.items() for w in ws for x in (w, s)))
    named = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.element_at(side, w).isNotNull())
    rows, cols = ({n: row for row, ns in zip(("top", "", "bottom"), REGIONS, strict=True) for n in ns}, {n: col for ns in REGIONS for col, n in zip(("left", "", "right"), ns, strict=True)})
    own = F.create_map(*(x for n in rows for x in (F.lit(n), F.array(*(F.lit(s) for s in (rows[n], cols[n]) if s)) if rows[n] or cols[n] else F.array().cast("array<string>"))))
    mine = F.coalesce(F.element_at(own, region_name), F.array().cast("array<string>"))
    names_own = F.exists(named, lambda w: F.array_contains(mine, F.element_at(side, w)))
    centre_ok = (region_name == "centre") | ((F.size(mine) == 1) & names_own)
    wrong = F.filter(named, lambda w: ~F.when(region_name.isNull(), F.lit(False)).when(F.element_at(side, w) == "centre", centre_ok).otherwise(F.array_contains(mine, F.element_at(side, w))))
    return F.get(wrong, F.lit(0))


def defect_sentence(number: Column, area_pct: Column, region_name: Column, score: Column) -> Column:
    part = lambda c, *x: F.when(c.isNotNull(), F.concat(*x)).otherwise("")
    return F.concat(F.lit("Reject"), part(number, F.format_string(" %03d", number)), F.lit(": anomaly"), part(area_pct, F.format_string(" covering %.1f %% of the part", area_pct)), part(region_name, F.lit(" at the "), region_name), part(score, F.format_string(", %.2f× the learned limit", score)), F.lit("."))


SEPARATOR = " · "
# What is said for each reason.
SAID = {
    "NO_OBJECT": "no part in view.",
    "TOUCHES_BORDER": "the part touches the edge of the view — move it fully into the frame.",
    "TOO_SMALL": "the part looks too small — move the camera closer.",
    "TOO_LARGE": "the part fills too much of the view — move the camera back.",
    "MULTIPLE": "more than one object — show one part at a time.",
    "NO_CORE": "the part could not be separated from the background.",
}


def _chosen(c: Column, table: dict[str, Column], other: Column) -> Column:
    out = other
    for k, v in reversed(table.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def _told(form: str, c: Column) -> Column:
    """c in that form, nothing for a null."""
    return F.when(c.isNotNull(), F.format_string(form, c)).otherwise("")


def sentence(verdict: Column, reason: Column, part: Column, number: Column, area_pct: Column, region_name: Column, score: Column) -> Column:
    """One sentence for any verdict; null columns leave their clause out."""
    passed = F.concat(F.lit("Pass: within the learned limit"), _told(" (%.2f×)", score), F.lit("."))
    refused = F.concat(F.lit("Not the enrolled part"), _chosen(F.lower(F.coalesce(reason, F.lit(""))), {
        "identity": F.concat(F.lit(": it does not look like the taught "), part, F.lit(".")),
        "shape": F.concat(F.lit(": its shape does not match the taught "), part, F.lit(".")),
        "fit": F.concat(F.lit(": overall it looks different from the taught "), part, F.lit(" — a similar object, not this one.")),
        "coverage": F.concat(F.lit(": most of its surface differs from the taught "), part, _told(" (%.1f %% of the part)", area_pct), F.lit(".")),
    }, F.lit(".")))
    again = F.concat(F.lit("Reframe: "), _chosen(F.upper(F.coalesce(reason, F.lit(""))), {k: F.lit(v) for k, v in SAID.items()}, F.lit("show the part again.")))
    return _chosen(verdict, {"DEFECT": defect_sentence(number, area_pct, region_name, score), "PASS": passed, "NOT_ENROLLED": refused}, again)


def facts_line(verdict: Column, reason: Column, part: Column, area_pct: Column, region_name: Column, row: Column, col: Column, gh: int, gw: int, score: Column) -> Column:
    """What is known about a verdict, in a line: only what its kind of verdict calls for, nulls left out."""
    pct, times = (F.nullif(_told(form, c), F.lit("")) for form, c in (("%.1f %% of part", area_pct), ("%.2f× limit", score)))
    where = F.concat(region_name, F.format_string(f" (row %d/{gh}, col %d/{gw})", row + 1, col + 1))
    more = {
        "DEFECT": F.concat_ws(SEPARATOR, where, pct, times),
        "PASS": F.concat_ws(SEPARATOR, times),
        "NOT_ENROLLED": F.concat_ws(SEPARATOR, reason, F.when(F.lower(reason) == "coverage", pct)),
    }
    return F.concat_ws(SEPARATOR, part, verdict, F.nullif(_chosen(verdict, more, F.concat_ws(SEPARATOR, reason)), F.lit("")))


def certificate(n: Column, sane: Column, m: Column, alpha: Column, cal_max: Column, tau: Column, confidence: float) -> Column:
    """A certificate in words: how many good presentations were seen, and which rate of false rejects they bound."""
    bound = F.when(m >= 1, F.format_string(f"false rejects at most %.2f %% ({100 * confidence:g} %% confidence)", 100 * alpha)).otherwise("no bound yet")
    return F.concat_ws("\n", F.format_string("%d presentations, %d sane, %d valid", n, sane, m), bound, F.format_string("limit %.4f, largest good score %s", tau, F.coalesce(F.nullif(_told("%.4f", cal_max), F.lit("")), F.lit("none"))))


def part_id(created_ms: Column, salt: Column) -> Column:
    """yyyyMMdd-HHmmss-xxxx in UTC."""
    at = F.to_utc_timestamp(F.timestamp_millis(created_ms), F.current_timezone())
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.lower(F.hex(F.pmod(salt, F.lit(65536)))), 4, "0"))


def valid_id(c: Column) -> Column:
    return c.rlike("^[0-9]{8}-[0-9]{6}-[0-9a-f]{4}$")


def variant(c: Column) -> Column:
    """A variant such as b2+mad+sm as a struct: base, border, outlier rule, and the marks that it names; null for what isn't one.
    Fixed values: the words base, b<N>, mad, 2nd, p90, l2, sm, pn, pnm, aug, noglob."""
    words_ = F.split(c, r"\+")
    ok = F.forall(words_, lambda w: w.rlike("^(base|b[0-9]+|mad|2nd|p90|l2|sm|pn|pnm|aug|noglob)$"))
    has = lambda w: F.array_contains(words_, w)
    border = F.coalesce(F.get(F.filter(words_, lambda w: w.rlike("^b[0-9]+$")), F.lit(0)).substr(F.lit(2), F.lit(9)).cast("int"), F.lit(0))
    rank = F.when(has("2nd"), "2nd").when(has("p90"), "p90").when(has("mad"), "mad").otherwise("max")
    flags = [has(w).alias(n) for w, n in (("l2", "l2"), ("sm", "smooth"), ("pn", "position"), ("pnm", "position_mean"), ("aug", "augment"))]
    return F.when(ok, F.struct(border.alias("border"), rank.alias("tau"), *flags, (~has("noglob")).alias("globals")))
