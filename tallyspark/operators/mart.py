"""Report mart: daily facts and the branch, specialist, route and ticket reports.

Each report is one conditional aggregate over the receipts. Grids come from exploding configured entity names
over the days seen, never from a join of two tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.category import (
    CRUISE,
    SPECIALIST_KIND,
    TICKET_ORDER_DAILY,
    TICKET_ORDER_TOTALS,
    branch_kind,
    listed_rank,
    route_category,
    ticket_category,
)
from tallyspark.functions.dates import day_text, month_key, time_of
from tallyspark.functions.keys import first_per_key, nulls_last
from tallyspark.rules import BusinessRules

LINES = ("tour", "cruise", "ticket")
UNASSIGNED = "未指定"

# The export columns with the roles each may be taken from, best first.
EXPORT_COLUMNS = {
    "receipt_no": ("receipt_no", "order_id", "summary_no"),
    "receipt_state": ("receipt_state", "receipt_status"),
    "order_id": ("order_id", "receipt_no"),
    "branch": ("branch",),
    "summary_no": ("summary_no", "receipt_no", "order_id"),
    "receipt_status": ("receipt_status", "receipt_state"),
    "original_currency": ("original_currency", "currency"),
    "fx_rate": ("fx_rate",),
    "amount": ("amount",),
    "base_amount": ("base_amount",),
    "receipt_type": ("receipt_type",),
    "pay_method": ("pay_method",),
    "pay_serial": ("pay_serial",),
    "operator": ("operator",),
    "customer": ("customer",),
    "sales_company": ("sales_company",),
    "salesperson": ("salesperson",),
    "receipt_time": ("receipt_time",),
    "receipt_month": ("receipt_month",),
    "tour_code": ("tour_code",),
    "tour_name": ("tour_name",),
    "days": ("days",),
    "qty": ("qty",),
    "currency": ("currency", "original_currency"),
    "receivable": ("receivable",),
    "received": ("received",),
    "trans_time": ("trans_time",),
    "trans_month": ("trans_month",),
    "dept_owner": ("dept_owner",),
    "dept": ("dept",),
    "dest_category": ("dest_category",),
    "dest_level1": ("dest_level1",),
    "dest_level2": ("dest_level2",),
    "dest_name": ("dest_name",),
    "sub_branch": ("sub_branch", "branch"),
    "source_tag": ("source_tag",),
}


@dataclass(frozen=True)
class Mart:
    """Normalised receipts of both tables (``is_tour`` tells them apart) with the rules the reports need.

    ``tie_order`` names columns that fix the order of receipts with the same transaction time.
    """

    receipts: DataFrame
    rules: BusinessRules
    tie_order: tuple[str, ...] = ()

    @property
    def tour(self) -> DataFrame:
        return self.receipts.where("is_tour").drop("is_tour")

    @property
    def others(self) -> DataFrame:
        return self.receipts.where(~F.col("is_tour")).drop("is_tour")

    # --- shared pieces ---------------------------------------------------------------------------------------

    def is_desk(self) -> Column:
        return F.coalesce(F.col("branch") == self.rules.specialist_desk, F.lit(False))

    def is_target(self) -> Column:
        return F.coalesce(F.col("branch").isin(*self.rules.target_branches), F.lit(False))

    def is_cruise(self) -> Column:
        return F.coalesce(F.col("dept").isin(*self.rules.cruise_depts), F.lit(False))

    @staticmethod
    def trans_day(df: DataFrame) -> Column:
        """Transaction day, else the official day."""
        return F.coalesce(F.to_date(time_of(df, "trans_time")), F.col("unified_date"))

    def lined(self, extra: tuple[str, ...] = ()) -> DataFrame:
        """Both tables in long form: one row per receipt with its business line."""
        line = F.when(~F.col("is_tour"), F.lit("ticket")).when(self.is_cruise(), F.lit("cruise")).otherwise(F.lit("tour"))
        return self.receipts.select("branch", "salesperson", "unified_date", "amount", *extra, line.alias("line"))

    @staticmethod
    def line_sums() -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(F.col("line") == line, F.col("amount"))), F.lit(0.0)).alias(line) for line in LINES
        ]

    def first_receipts(self) -> DataFrame:
        """Earliest transaction of each tour order; unknown times come last."""
        keep = ["order_id", "branch", "salesperson", "dept", "dest_category", "days", "qty", "trans_time", "unified_date"]
        extra = [c for c in self.tie_order if c not in keep]
        slim = self.tour.select(*keep, *extra)
        order = [*nulls_last(time_of(slim, "trans_time")), *[F.col(c) for c in self.tie_order]]
        return first_per_key(slim, ["order_id"], order).drop(*extra)

    def _routes(self, df: DataFrame, day: Column) -> DataFrame:
        return df.withColumns(
            {"route": route_category(F.col("dept"), F.col("dest_category"), self.rules.cruise_depts), "day": day}
        )

    def tickets(self) -> DataFrame:
        category = ticket_category(F.col("tour_name"), F.col("source_tag"))
        work = self.others.withColumns({"ticket": category, "day": self.trans_day(self.others)})
        return work.where(F.col("ticket").isNotNull())

    @staticmethod
    def days_label() -> Column:
        """Whole trip days print without decimals."""
        d = F.col("days")
        return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))

    # --- daily facts -----------------------------------------------------------------------------------------

    def facts(self) -> DataFrame:
        """Every configured branch and every specialist on every day, with the three line amounts.

        The receipts are read and aggregated once: each day holds the sums of its configured entities, at most one for each,
        and every row of the grid looks its own up. Days on which nothing but other entities sold are kept.
        """
        lined = self.lined().where(F.col("unified_date").isNotNull())
        desk = F.coalesce(F.col("branch") == self.rules.specialist_desk, F.lit(False))
        channel = F.when(desk, F.lit("specialist")).otherwise(F.lit("branch"))
        entity = F.coalesce(F.when(desk, F.col("salesperson")).otherwise(F.col("branch")), F.lit(""))
        sums = lined.groupBy(channel.alias("channel"), entity.alias("entity"), "unified_date").agg(*self.line_sums())
        listed = [("branch", code, name) for code, name in self.rules.branches.items()]
        listed += [("specialist", name, name) for name in self.rules.specialists]
        rows = [F.struct(F.lit(c).alias("channel"), F.lit(k).alias("code"), F.lit(n).alias("entity")) for c, k, n in listed]
        of = {c: [n for x, _, n in listed if x == c] for c in ("branch", "specialist")}
        wanted = F.when(F.col("channel") == "specialist", F.col("entity").isin(*of["specialist"])).otherwise(F.col("entity").isin(*of["branch"]))
        held = F.collect_list(F.when(wanted, F.struct("channel", "entity", *LINES)))
        grid = sums.groupBy("unified_date").agg(held.alias("_sums")).select("unified_date", "_sums", F.explode(F.array(*rows)).alias("e"))
        own = F.get(F.filter("_sums", lambda s: (s["channel"] == F.col("e.channel")) & (s["entity"] == F.col("e.entity"))), F.lit(0))
        joined = grid.select("unified_date", "e.*", own.alias("_own")).select("unified_date", "channel", "code", "entity", *[f"_own.{x}" for x in LINES])
        kind = F.when(F.col("channel") == "specialist", F.lit(SPECIALIST_KIND)).otherwise(branch_kind(F.col("entity")))
        return joined.select(
            "channel",
            "code",
            "entity",
            kind.alias("kind"),
            F.col("unified_date").alias("day"),
            month_key(F.col("unified_date")).alias("month"),
            *[F.coalesce(line, F.lit(0.0)).alias(line) for line in LINES],
        )

    def branch_facts(self) -> DataFrame:
        return self.facts().where(F.col("channel") == "branch").drop("channel")

    def specialist_facts(self) -> DataFrame:
        return self.facts().where(F.col("channel") == "specialist").drop("channel")

    def branch_salesperson_facts(self) -> DataFrame:
        """Branch, salesperson and day: three amounts, tour people and ticket quantity."""
        names = list(self.rules.branches.values())
        seller = F.trim(F.coalesce("salesperson", F.lit("")))
        seller = F.when(seller == "", F.lit(UNASSIGNED)).otherwise(seller)

        def own(df: DataFrame) -> DataFrame:
            return df.where(F.col("branch").isin(*names) & ~self.is_desk())

        amounts = own(self.lined()).select("branch", seller.alias("salesperson"), F.col("unified_date").alias("day"), "line", "amount")
        # the first receipt is chosen among the receipts of these branches
        scoped = Mart(own(self.receipts), self.rules, self.tie_order)
        first = scoped.first_receipts()
        people = first.select(
            "branch", seller.alias("salesperson"), self.trans_day(first).alias("day"), F.lit("people").alias("line"), F.col("qty").alias("amount")
        )
        sold = own(self.tickets()).select(
            "branch", seller.alias("salesperson"), "day", F.lit("quantity").alias("line"), F.col("qty").alias("amount")
        )
        wanted = (*LINES, "people", "quantity")
        sums = [F.coalesce(F.sum(F.when(F.col("line") == w, F.col("amount"))), F.lit(0.0)).alias(w) for w in wanted]
        out = amounts.unionByName(people).unionByName(sold).groupBy("branch", "salesperson", "day").agg(*sums)
        any_value = F.lit(False)
        for w in wanted:
            any_value = any_value | (F.col(w) != 0)
        out = out.where(any_value)
        return out.select(
            "branch",
            branch_kind(F.col("branch")).alias("kind"),
            "salesperson",
            "day",
            month_key(F.col("day")).alias("month"),
            *LINES,
            F.col("people").alias("tour_people"),
            F.col("quantity").alias("ticket_quantity"),
        )

    # --- counts ----------------------------------------------------------------------------------------------

    def _scope(self, df: DataFrame, scope: str) -> DataFrame:
        if scope == "branch":
            return df.where(self.is_target())
        return df.where(self.is_desk()) if scope == "specialist" else df

    def tour_people(self, scope: str) -> DataFrame:
        """People by route, trip days and day, from first receipts."""
        first = self.first_receipts()
        work = self._scope(self._routes(first, self.trans_day(first)), scope)
        out = work.groupBy("route", "days", "day").agg(F.sum("qty").alias("people")).where(F.col("people") > 0)
        return out.select("route", self.days_label().alias("days"), "day", month_key(F.col("day")).alias("month"), "people")

    def ticket_quantity(self, scope: str) -> DataFrame:
        work = self._scope(self.tickets(), scope)
        out = work.groupBy("ticket", "day").agg(F.sum("qty").alias("quantity")).where(F.col("quantity") > 0)
        return out.select(
            "ticket",
            "day",
            month_key(F.col("day")).alias("month"),
            "quantity",
            listed_rank(F.col("ticket"), TICKET_ORDER_TOTALS).alias("ticket_rank"),
        )

    def _entity(self, scope: str) -> str:
        return "branch" if scope == "branch" else "salesperson"

    def daily_people(self, scope: str) -> DataFrame:
        """People per entity and day, cruise apart from the rest."""
        first = self.first_receipts()
        work = self._scope(self._routes(first, self.trans_day(first)), scope)
        on_cruise = F.col("route") == CRUISE
        out = work.groupBy(F.col(self._entity(scope)).alias("entity"), "day").agg(
            F.coalesce(F.sum(F.when(~on_cruise, F.col("qty"))), F.lit(0.0)).alias("tour_people"),
            F.coalesce(F.sum(F.when(on_cruise, F.col("qty"))), F.lit(0.0)).alias("cruise_people"),
        )
        return out.where((F.col("tour_people") > 0) | (F.col("cruise_people") > 0)).withColumn("month", month_key(F.col("day")))

    def daily_tickets(self, scope: str) -> DataFrame:
        work = self._scope(self.tickets(), scope)
        out = work.groupBy(F.col(self._entity(scope)).alias("entity"), "ticket", "day").agg(F.sum("qty").alias("quantity"))
        return out.where(F.col("quantity") > 0).withColumns(
            {"month": month_key(F.col("day")), "ticket_rank": listed_rank(F.col("ticket"), TICKET_ORDER_DAILY)}
        )

    # --- money -----------------------------------------------------------------------------------------------

    def _money(self, work: DataFrame, kind: str) -> DataFrame:
        out = work.groupBy("branch", kind, "days", "day").agg(F.sum("amount").alias("amount")).where(F.col("amount") != 0)
        return out.select(
            "branch", kind, self.days_label().alias("days"), "day", month_key(F.col("day")).alias("month"), "amount"
        )

    def branch_route_money(self) -> DataFrame:
        return self._money(self._routes(self.tour, self.trans_day(self.tour)).where(self.is_target()), "route")

    def branch_ticket_money(self) -> DataFrame:
        return self._money(self.tickets().where(self.is_target()), "ticket")

    def route_daily(self, scope: str) -> DataFrame:
        """People from first receipts and money from all receipts, by entity, route and official day."""

        def pick(df: DataFrame) -> DataFrame:
            if scope == "branch":
                return df.where(self.is_target())
            return df.where(self.is_desk() & F.col("salesperson").isin(*self.rules.specialists))

        entity = F.col(self._entity(scope)).alias("entity")
        day = F.col("unified_date")
        first = pick(self._routes(self.first_receipts(), day)).select(entity, "route", "day", F.col("qty").alias("people"), F.lit(0.0).alias("amount"))
        money = pick(self._routes(self.tour, day)).select(entity, "route", "day", F.lit(0.0).alias("people"), "amount")
        out = first.unionByName(money).groupBy("entity", "route", "day").agg(F.sum("people").alias("people"), F.sum("amount").alias("amount"))
        return out.where((F.col("people") != 0) | (F.col("amount") != 0)).withColumn("month", month_key(F.col("day")))

    def facts_long(self) -> DataFrame:
        """The daily grids of both channels with one row per business line."""
        return self.facts().unpivot(["channel", "code", "entity", "kind", "day", "month"], list(LINES), "line", "amount")

    # --- bundles ---------------------------------------------------------------------------------------------

    def reports(self, with_salesperson: bool = False) -> dict[str, DataFrame]:
        """All report datasets by name, lazily."""
        out = {"branch_facts": self.branch_facts()}
        if with_salesperson:
            out["branch_salesperson_facts"] = self.branch_salesperson_facts()
        out.update(
            {
                "specialist_facts": self.specialist_facts(),
                "branch_tour_people": self.tour_people("branch"),
                "specialist_tour_people": self.tour_people("specialist"),
                "branch_ticket_quantity": self.ticket_quantity("branch"),
                "specialist_ticket_quantity": self.ticket_quantity("specialist"),
                "all_ticket_quantity": self.ticket_quantity("all"),
                "branch_daily_people": self.daily_people("branch"),
                "specialist_daily_people": self.daily_people("specialist"),
                "branch_daily_tickets": self.daily_tickets("branch"),
                "specialist_daily_tickets": self.daily_tickets("specialist"),
                "branch_route_money": self.branch_route_money(),
                "branch_ticket_money": self.branch_ticket_money(),
                "detail_all": export_detail(self.receipts),
                "detail_tour": export_detail(self.tour),
                "detail_others": export_detail(self.others),
                "branch_route_daily": self.route_daily("branch"),
                "specialist_route_daily": self.route_daily("specialist"),
            }
        )
        return out


def tag_tables(tour: DataFrame, others: DataFrame) -> DataFrame:
    """Both detail tables as one frame. Filters on the literal tag prune the other table's scan."""
    a = tour.withColumn("is_tour", F.lit(True))
    return a.unionByName(others.withColumn("is_tour", F.lit(False)), allowMissingColumns=True)


def export_detail(df: DataFrame) -> DataFrame:
    """The fixed export columns as text; absent columns take an alias, nulls become blanks."""
    out = []
    for name, roles in EXPORT_COLUMNS.items():
        source = next((r for r in roles if r in df.columns), None)
        value = F.lit("") if source is None else F.coalesce(_as_text(df, source), F.lit(""))
        out.append(value.alias(name))
    return df.select(*out)


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return day_text(F.col(name))
    if kind.startswith("timestamp"):
        return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss")
    return F.col(name).cast("string")


def report_variants(receipts: DataFrame, rules: BusinessRules, tie_order: tuple[str, ...] = ()) -> dict[str, dict[str, DataFrame]]:
    """The three report sets: everything, without write-offs, and the official scope with the salesperson sheet."""
    from tallyspark.operators.scope import official_rows

    def build(types, methods, with_salesperson):
        return Mart(official_rows(receipts, types, methods), rules, tie_order).reports(with_salesperson)

    return {
        "all": build((), (), False),
        "no_write_off": build(rules.excluded_types, (), False),
        "official": build(rules.excluded_types, rules.excluded_methods, True),
    }
