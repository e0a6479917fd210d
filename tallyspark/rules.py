"""Business rules: prefix map, exclusion prefixes, lists and reassignment overrides.

Rules are configuration of bounded size. They become literal expressions, so no operator has to join or
broadcast them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# The default prefix map, exclusion prefixes, desk and cruise departments.
DEFAULT_BRANCH_MAP = {
    "33": "銅鑼灣分社",
    "47": "太古分社",
    "36": "旺角銀行中心分社",
    "31": "將軍澳分社",
    "19": "沙田分社",
    "17": "荃灣綠楊坊分社",
    "27": "屯門市廣場分社",
    "03": "觀塘分社",
    "20": "大埔分社",
    "95": "西九龍站分社",
    "09": "機場服務處",
    "E2": "九龍灣服務點",
    "E3": "沙田服務點",
    "E4": "葵涌服務點",
    "E5": "屯門服務點",
    "E6": "上環服務點",
    "E7": "九龍維景酒店服務點",
    "E8": "筲箕灣服務點",
    "E9": "元朗服務點",
    "0A": "展覽會場專用",
    "0B": "展覽會場專用2",
    "225": "營銷運營中心-專職銷售組",
}
DEFAULT_SPECIALIST_DESK = "營銷運營中心-專職銷售組"
DEFAULT_EXCLUDE_PREFIXES = ("1950506", "1950404", "1950202")
DEFAULT_CRUISE_DEPTS = ("郵輪事業部-郵輪線業務組", "移走-郵輪事業部")
DEFAULT_OVERRIDES = (
    {"month": "2026-06", "from_prefix": "E6", "from_branch": "上環服務點", "to_prefix": "0A", "to_branch": "展覽會場專用"},
    {
        "month": "2026-06",
        "source_order_id": "E9MF16613172500",
        "from_branch": "上環服務點",
        "to_prefix": "0A",
        "to_branch": "展覽會場專用",
    },
)
# Receipts that take their whole order out of the official scope.
EXCLUDED_RECEIPT_TYPES = ("掛賬核銷",)
EXCLUDED_PAY_METHODS = ("TT 退款轉團款",)
SCOPE_LABEL = "不含掛賬核銷與TT退款轉團款"


@dataclass(frozen=True)
class BusinessRules:
    branch_map: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_BRANCH_MAP))
    exclude_prefixes: tuple[str, ...] = DEFAULT_EXCLUDE_PREFIXES
    target_branches: tuple[str, ...] = ()
    specialists: tuple[str, ...] = ()
    cruise_depts: tuple[str, ...] = DEFAULT_CRUISE_DEPTS
    overrides: tuple[dict, ...] = DEFAULT_OVERRIDES
    specialist_desk: str = DEFAULT_SPECIALIST_DESK
    excluded_types: tuple[str, ...] = EXCLUDED_RECEIPT_TYPES
    excluded_methods: tuple[str, ...] = EXCLUDED_PAY_METHODS

    def __post_init__(self):
        names = [n for n in self.branch_map.values() if n != self.specialist_desk]
        if len(names) != len(set(names)):
            raise ValueError("two branch codes share one name; the daily grid would count it twice")
        if not self.target_branches:
            object.__setattr__(self, "target_branches", (*dict.fromkeys(names), "未知"))

    @property
    def branches(self) -> dict[str, str]:
        """Code to name, without the specialist desk."""
        return {code: name for code, name in self.branch_map.items() if name != self.specialist_desk}

    def contract(self) -> dict:
        return {
            "branchMapping": dict(sorted(self.branch_map.items())),
            "targetBranches": list(self.target_branches),
            "cruiseDepartments": list(self.cruise_depts),
            "salesReps": list(self.specialists),
        }

    def fingerprint(self) -> str:
        text = json.dumps(self.contract(), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode("utf-8")).hexdigest()


# The keys of a rules file.
RULE_FILE_SCHEMA = T.StructType(
    [
        T.StructField("BRANCH_MAPPING", T.MapType(T.StringType(), T.StringType())),
        T.StructField("BRANCH_REASSIGNMENT_OVERRIDES", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("EXCLUDE_PREFIXES", T.ArrayType(T.StringType())),
        T.StructField("TARGET_BRANCHES_S3", T.ArrayType(T.StringType())),
        T.StructField("SALES_REP_LIST", T.ArrayType(T.StringType())),
        T.StructField("CRUISE_DEPTS", T.ArrayType(T.StringType())),
    ]
)


def clean_list(values) -> tuple[str, ...]:
    """Trimmed, non-blank, first occurrence kept; a plain string is split on commas."""
    if values is None:
        return ()
    raw = values.replace("，", ",").split(",") if isinstance(values, str) else values
    texts = (str(v).replace("　", " ").strip() for v in raw)
    return tuple(dict.fromkeys(t for t in texts if t))


def load_rules(spark: SparkSession, path: str, defaults: BusinessRules | None = None) -> BusinessRules:
    """Read a rules file over the defaults; a missing or unreadable file gives the defaults."""
    base = defaults or BusinessRules()
    try:
        row = spark.read.schema(RULE_FILE_SCHEMA).json(path, multiLine=True).first()
    except Exception:
        return base
    if row is None:
        return base
    loaded = row.asDict(recursive=True)
    changes: dict = {}
    if loaded["BRANCH_MAPPING"] is not None:
        pairs = ((clean_list([k]), clean_list([v])) for k, v in loaded["BRANCH_MAPPING"].items())
        changes["branch_map"] = {k[0].upper(): v[0] for k, v in pairs if k and v}
        changes["target_branches"] = ()
    if loaded["BRANCH_REASSIGNMENT_OVERRIDES"] is not None:
        changes["overrides"] = tuple(loaded["BRANCH_REASSIGNMENT_OVERRIDES"])
    for key, attribute in (
        ("EXCLUDE_PREFIXES", "exclude_prefixes"),
        ("TARGET_BRANCHES_S3", "target_branches"),
        ("SALES_REP_LIST", "specialists"),
        ("CRUISE_DEPTS", "cruise_depts"),
    ):
        if loaded[key] is not None:
            changes[attribute] = clean_list(loaded[key])
    return replace(base, **changes)
