"""Business classification of branches, routes, tickets and product lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Branch kind by a text it contains, first hit wins.
BRANCH_KINDS = (("分社", "門店"), ("服務", "服務點"), ("展覽", "展覽"))
OTHER_BRANCH_KIND = "其他"
SPECIALIST_KIND = "專職銷售"

# Route category by a text in the destination, first hit wins.
CRUISE = "郵輪"
ROUTE_KEYWORDS = ((("海外", "台灣", "臺灣"), "海外"), (("港", "澳"), "港澳"), (("中國長線",), "中國長線"))
OTHER_ROUTE = "其他"

# Ticket category rules in order: (text searched, keywords, category).
TICKET_RULES = (
    ("tag", ("酒店",), "酒店"),
    ("tag", ("套票",), "套票"),
    ("tour", ("機票",), "機票"),
    ("tour", ("高鐵",), "高鐵"),
    ("tour", ("船票", "珠江船務"), "船票"),
    ("tour", ("巴士",), "巴士票"),
    ("tag", ("門券", "門票"), "其它門券"),
)
# The two orders in which ticket categories are listed.
TICKET_ORDER_TOTALS = ("船票", "巴士票", "機票", "高鐵", "其它門券", "套票", "酒店")
TICKET_ORDER_DAILY = ("其它門券", "巴士票", "船票", "高鐵", "機票", "酒店", "套票")

# Product line keywords for the driver analysis.
TICKET_FAMILY = ("套票", "酒店", "門券", "交通", "票務")
TICKET_FAMILY_LABELS = ("酒店", "門券", "交通", "套票")
TOUR_LINE = "旅行團"
TICKET_LINE = "票務"


def contains_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def branch_kind(c: Column) -> Column:
    out = F.lit(OTHER_BRANCH_KIND)
    for word, kind in reversed(BRANCH_KINDS):
        out = F.when(c.contains(word), F.lit(kind)).otherwise(out)
    return out


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def route_category(dept: Column, destination: Column, cruise_depts) -> Column:
    place = _trimmed(destination)
    out = F.when(place.isin("", "nan", "None"), F.lit(OTHER_ROUTE)).otherwise(place)
    for words, label in reversed(ROUTE_KEYWORDS):
        out = F.when(contains_any(place, words), F.lit(label)).otherwise(out)
    return F.when(_trimmed(dept).isin(*cruise_depts), F.lit(CRUISE)).otherwise(out)


def ticket_category(tour_name: Column, source_tag: Column, unmatched: str = "未匹配") -> Column:
    """Null means "no ticket": such rows leave the ticket reports."""
    texts = {"tour": _trimmed(tour_name), "tag": _trimmed(source_tag)}
    out = F.lit(None).cast("string")
    for field, words, label in reversed(TICKET_RULES):
        out = F.when(contains_any(texts[field], words), F.lit(label)).otherwise(out)
    return F.when(texts["tag"].contains(unmatched), F.lit(None).cast("string")).otherwise(out)


def listed_rank(c: Column, listed) -> Column:
    """Position in a fixed list, for sorting by business order."""
    return F.array_position(F.array(*[F.lit(v) for v in listed]), c)


def product_line(*texts: Column) -> Column:
    joined = F.concat_ws(" ", *texts)
    family = F.lit(TICKET_LINE)
    for label in reversed(TICKET_FAMILY_LABELS):
        family = F.when(joined.contains(label), F.lit(label)).otherwise(family)
    return (
        F.when(joined.contains(CRUISE), F.lit(CRUISE))
        .when(contains_any(joined, TICKET_FAMILY), family)
        .otherwise(F.lit(TOUR_LINE))
    )


# Texts that mark long-haul rows and specialist rows.
LONG_HAUL_PATTERN = "長線|長綫|長線組|長綫組|中國長"
SPECIALIST_WORD = "專職"


def is_long_haul(dest_category: Column, dept: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(dest_category, F.lit("")), F.coalesce(dept, F.lit(""))).rlike(LONG_HAUL_PATTERN)


def is_specialist(desk: str, *texts: Column) -> Column:
    hit = F.lit(False)
    for c in texts:
        text = _trimmed(c)
        hit = hit | (text == desk) | text.contains(SPECIALIST_WORD)
    return hit
