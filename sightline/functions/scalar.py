"""Scalar functions (Column in, Column out): boxes, packed codes, names, scores, decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- boxes: columns x1, y1, x2, y2 ---------------------------------------------------------------------------------------


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, w, h) -> Column:
    """Whole pixels around the box inside the image, or null if that is empty or `box_fault` finds a fault."""
    low = lambda v: F.floor(F.greatest(v, F.lit(0.0))).cast("int")
    high = lambda v, m: F.ceil(F.least(v, F.lit(float(m)))).cast("int")
    box = F.struct(low(x1).alias("x1"), low(y1).alias("y1"), high(x2, w).alias("x2"), high(y2, h).alias("y2"))
    return F.when(box_fault(x1, y1, x2, y2).isNull() & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def box_fault(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """What is wrong with a box: a coordinate that is missing or not finite, or sides that do not grow; null for a good one."""
    bad = F.lit(False)
    for v in (x1, y1, x2, y2):
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, "coordinates must be finite").when(~((x2 > x1) & (y2 > y1)), "a box must have a positive width and height")


def pad_box(x1: Column, y1: Column, x2: Column, y2: Column, share: float) -> list[Column]:
    dx, dy = (x2 - x1) * share, (y2 - y1) * share
    return [x1 - dx, y1 - dy, x2 + dx, y2 + dy]


def pad_box_whole(x1: Column, y1: Column, x2: Column, y2: Column, share: float) -> list[Column]:
    """The padding is cut to whole pixels first."""
    dx, dy = ((x2 - x1) * share).cast("int"), ((y2 - y1) * share).cast("int")
    return [x1 - dx, y1 - dy, x2 + dx, y2 + dy]


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def intersection(a: list[Column], b: list[Column]) -> Column:
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: list[Column], b: list[Column]) -> Column:
    both = intersection(a, b)
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


# ---- packed codes ----------------------------------------------------------------------------------------------------------


#: Tail of a packed code: flags after X (left, right) and after S (left, middle, right); a fixed value of the format.
CODE_TAIL = r"X(.)(.)S(...)(_*)$"


def _code_body(code: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(code, F.lit(""))), r"^\d", "")


def _code_slots(code: Column) -> list[Column]:
    """The five characters of the tail; empty where there is none."""
    body = _code_body(code)
    three = F.regexp_extract(body, CODE_TAIL, 3)
    return [F.regexp_extract(body, CODE_TAIL, 1), F.regexp_extract(body, CODE_TAIL, 2), *[F.substring(three, i, 1) for i in (1, 2, 3)]]


def parse_code(code: Column) -> Column:
    """sex (B or C), decade (two digits of the birth decade), left_tusk, right_tusk, has_tail, and the tail's five flags of a packed code.

    One leading digit is dropped after trimming.  Tusks follow a T at the fourth place and are both known or both null; a flag that is
    neither 0 nor 1 is null."""
    body = _code_body(code)
    tusks = F.substring(body, 5, 2)
    known = (F.substring(body, 4, 1) == "T") & F.regexp_like(tusks, F.lit("^[01]{2}$"))
    flag = lambda c: F.when(c.isin("0", "1"), c.cast("int"))
    names = ("extreme_left", "extreme_right", "special_left", "special_mid", "special_right")
    return F.struct(
        F.when(F.substring(body, 1, 1).isin("B", "C"), F.substring(body, 1, 1)).alias("sex"),
        F.when(F.regexp_like(F.substring(body, 2, 2), F.lit(r"^\d{2}$")), F.substring(body, 2, 2).try_cast("int")).alias("decade"),
        F.when(known, F.substring(tusks, 1, 1).cast("int")).alias("left_tusk"),
        F.when(known, F.substring(tusks, 2, 1).cast("int")).alias("right_tusk"),
        F.regexp_like(body, F.lit(CODE_TAIL)).alias("has_tail"),
        *[flag(c).alias(n) for c, n in zip(_code_slots(code), names)],
    )


def explicit_feature(code: Column) -> Column:
    """Whether a packed code says that something is not normal: a tusk slot is 0, or a flag of the tail is 1."""
    body = _code_body(code)
    tusk = (F.length(body) >= 6) & (F.substring(body, 4, 1) == "T") & ((F.substring(body, 5, 1) == "0") | (F.substring(body, 6, 1) == "0"))
    flags = F.lit(False)
    for c in _code_slots(code):
        flags = flags | (c == "1")
    return tusk | flags


def year_of(text: Column) -> Column:
    return F.get(F.split(text, "-"), F.lit(0)).try_cast("int")


def age(decade: Column, year: Column) -> Column:
    """Age by the middle of a birth decade (its last two digits): the latest such decade that does not begin after the year, else that of the
    1900s; at least 0."""
    born = F.when(2000 + decade <= year, 2000 + decade).otherwise(1900 + decade) + 5
    return F.when(decade.isNotNull() & year.isNotNull(), F.greatest(F.lit(0), year - born))


def parse_stem(stem: Column, pattern: str, names: list[str]) -> Column:
    """Groups of a pattern as a struct; null if the stem does not match."""
    return F.when(F.regexp_like(stem, F.lit(pattern)), F.struct(*[F.regexp_extract(stem, pattern, i + 1).alias(n) for i, n in enumerate(names)]))


#: Forms of file stems: name, date and running number; photo and side; name and date with an optional copy number.
NAME_DATE_SEQ = r"^(.+)_(\d{4}-\d{2}-\d{2})_(\d+)$"
PHOTO_SIDE = r"^(.+)_(left|right)$"


def safe_component(text: Column, fallback: str = "identity") -> Column:
    clean = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


# ---- scores ----------------------------------------------------------------------------------------------------------------


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ramp(x: Column, low: float, high: float) -> Column:
    if high <= low:
        raise ValueError("a ramp must rise")
    return clamp((x - low) / (high - low))


def band(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 outside a..d, 1 inside b..c, straight lines between."""
    if not a < b <= c < d:
        raise ValueError("a band needs a < b <= c < d")
    return F.when((x <= a) | (x >= d), F.lit(0.0)).when(x < b, (x - a) / (b - a)).when(x > c, (d - x) / (d - c)).otherwise(F.lit(1.0))


def geometric_mean(values: list[tuple[Column, float]], floor: float = 1e-6) -> Column:
    total = sum(w for _, w in values)
    out = F.lit(0.0)
    for x, w in values:
        out = out + F.log(F.greatest(x, F.lit(floor))) * w
    return F.exp(out / total)


#: Names of the tiers, the best first (fixed values).
TIERS = ("excellent", "great", "good", "acceptable", "poor")


def tier(x: Column, cuts: list[float]) -> Column:
    """0 for the best: the first of descending cuts that x reaches.  What is null or not finite is in the last tier."""
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(x >= cuts[i], F.lit(i)).otherwise(out)
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.when(finite, out).otherwise(F.lit(len(cuts)))


def tier_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TIERS]), number)


def mask_fill(area_: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of its box that a mask fills; null for an empty box."""
    return F.when((x2 > x1) & (y2 > y1), area_ / ((x2 - x1) * (y2 - y1)))


def root_offset(upper_x: Column, lower_x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far the middle of the two anchors is from the middle of the box, in widths of the box; null for an empty box."""
    return F.when((x2 > x1) & (y2 > y1), F.abs((upper_x + lower_x) / 2 - (x1 + x2) / 2) / (x2 - x1))


def aspect_band(width: Column, height: Column, low: float = 0.7, high: float = 0.9) -> Column:
    """in_band (both limits included), ratio (three decimals, half to even) and pixels of a crop."""
    ratio = width / height
    return F.struct(ratio.between(low, high).alias("in_band"), F.bround(ratio, 3).alias("ratio"), (width * height).alias("pixels"))


def shape_reason(area_: Column, perimeter: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Why a shape in an image of this width and height is rejected, null if it is not; a later test overrides an earlier one: circularity,
    aspect, area, edge.  A shape without perimeter is degenerate."""
    circularity, aspect = 4 * F.pi() * area_ / (perimeter * perimeter), (x2 - x1) / (y2 - y1)
    edge = (F.abs(x2 - width) < 5) | (F.abs(y2 - height) < 5) | (x1 < 5) | (y1 < 5)
    return (
        F.when(perimeter == 0, "degenerate")
        .when(edge, "edge")
        .when((area_ / (width * height) < 0.025) | (area_ < 50_000), "area")
        .when((aspect < 0.5) | (aspect > 1.2), "aspect")
        .when((circularity < 0.4) | (circularity > 0.9), "circularity")
    )


def blob_reason(share: Column, elongation: Column, solidity: Column, circularity: Column, tone: Column, edge: Column, texture: Column) -> Column:
    """The first test that a blob fails, null if none; share is its part of the whole area, and one of the three cues of contrast is enough."""
    return (
        F.when(~share.between(8e-5, 6e-3), "area")
        .when(elongation > 3.2, "elongated")
        .when(solidity < 0.8, "ragged")
        .when(circularity < 0.35, "noncircular")
        .when(~((tone >= 6.0) | (edge >= 22.0) | (texture >= 9.0)), "no_contrast")
    )


#: Status and next action of a sighting, in the order in which they are tested (fixed values).
WORKFLOW = (
    ("Unresolved", "Review saved"),
    ("Decided", "View confirmation"),
    ("Failed", "Inspect error"),
    ("Analyzing", "Wait for analysis"),
    ("Needs evidence review", "Approve left and right ears"),
    ("Ready to match", "Rank known-elephant catalog"),
    ("Needs decision", "Confirm identity decision"),
)
#: Old names of decisions and the present ones (fixed values).
ACTIONS = {"confirm": "existing_known_elephant", "enroll": "new_known_elephant"}


def workflow_status(decision: Column, status: Column, approved: Column, matched: Column) -> tuple[Column, Column]:
    """Status and next action by the decision's action (null: none), the status of the analysis, and whether evidence is approved and a match there."""
    tests = (decision == "unresolved", decision.isNotNull(), status == "failed", status == "analyzing", ~approved, ~matched, F.lit(True))
    out = []
    for part in (0, 1):
        chain = F
        for test, names in zip(tests, WORKFLOW):
            chain = chain.when(F.coalesce(test, F.lit(False)), names[part])
        out.append(chain)
    return out[0], out[1]


def normal_action(action: Column) -> Column:
    """The present name of a decision; others stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, action), action)


def sighting_date(dates: Column, fallback: Column) -> Column:
    """The first date that is neither null nor empty in an array, else the fallback."""
    return F.coalesce(F.get(F.filter(dates, lambda d: d.isNotNull() & (d != "")), F.lit(0)), fallback)


def candidate_id(row: Column, side: Column, photo: Column) -> Column:
    """Identifier of a profile row as a candidate."""
    return F.concat(F.lit("profile:"), row.cast("string"), F.lit(":"), side, F.lit(":"), photo)


def crop_id(photo: Column, side: Column, index: Column) -> Column:
    """Identifier of one of a photo's crops."""
    return F.concat_ws("__", photo, side, index.cast("string"))


def crop_key(photo: Column, box: list[Column]) -> Column:
    """Key of what is stored for a photo's crop."""
    return F.concat(photo, F.lit("__crop_"), F.concat_ws("_", *[c.cast("string") for c in box]))


def profile_key(photo: Column, segmentation: Column, landmarks: Column, side: Column, box: list[Column]) -> Column:
    """Key of the profiles of a photo's crop by the producers of its segmentation and landmarks."""
    text = lambda t: F.lit(t)
    return F.concat(photo, text("__seg_"), segmentation, text("__landmarks_"), landmarks, text("__side_"), side, text("__crop_"), F.concat_ws("_", *[c.cast("string") for c in box]))


def grown_label(box: list[Column], points: list[tuple[Column, Column]], share: float = 0.15) -> Column:
    """x, y, w, h, area (three decimals) of the smallest box around a box and its key points, relative to the crop that pads the box by `share` to the
    left and top, but not past the image.  Noise of the product beyond six decimals is rounded off before the area is."""
    left, top = box[0] - F.greatest(F.lit(0.0), box[0] - (box[2] - box[0]) * share), box[1] - F.greatest(F.lit(0.0), box[1] - (box[3] - box[1]) * share)
    xs, ys = [x for x, _ in points], [y for _, y in points]
    x1, y1 = F.least(left, *xs), F.least(top, *ys)
    w, h = F.greatest(box[2] - box[0] + left, *xs) - x1, F.greatest(box[3] - box[1] + top, *ys) - y1
    return F.struct(*[F.round(value, 3).alias(name) for name, value in (("x", x1), ("y", y1), ("w", w), ("h", h), ("area", F.round(w * h, 6)))])


def by_height(a: Column, b: Column) -> Column:
    """An array of two key points (structs with y): the one with the greater y, then the one with the smaller y.  Of two at one height b stands in both places."""
    return F.array(F.when(a["y"] > b["y"], a).otherwise(b), F.when(a["y"] < b["y"], a).otherwise(b))


def alignment_penalty(shift: Column, stretch: Column, bins: int, shift_scale: float = 0.16, stretch_scale: float = 0.32) -> Column:
    """Factor below 1 for shifting by bins and stretching."""
    return F.exp(-F.pow(F.abs(shift) / bins / shift_scale, F.lit(4.0))) * F.exp(-F.pow(F.abs(F.log(stretch)) / stretch_scale, F.lit(4.0)))


def gradient_factor(stretch: Column) -> Column:
    """What a stretch does to slopes whose signed square root is compared."""
    return F.pow(stretch, F.lit(-0.5))
