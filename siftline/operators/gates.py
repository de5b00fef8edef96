"""Three-valued gates over candidates' text: kind, size, location, vertical. All native expressions.

A gate says pass, fail or unknown. The funnel runs the gates that a profile asks, in order, and stops at the first failure:
later gates are absent from the trace. Silence is unknown, never a pass; a snippet may eliminate but can't confirm a kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import text as T

GATES = ("kind", "size", "location", "vertical")


@dataclass(frozen=True)
class Profile:
    """What a lane asks of candidates. Zero and empty switch a gate off; ``allows`` other than services asks no kind."""

    allows: str = "services"
    size_min: int = 0
    size_max: int = 0
    locations: tuple[str, ...] = ()
    verticals: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: dict | None) -> Profile:
        """A profile from loose settings: one word stands for a list, blanks and what is no number for nothing."""
        given = given or {}

        def words(key: str) -> tuple[str, ...]:
            value = given.get(key)
            listed = [value] if isinstance(value, str) else value if isinstance(value, (list, tuple, set)) else []
            return tuple(str(v) for v in listed if str(v).strip())

        def number(key: str) -> int:
            value = str(given.get(key) or 0)
            return int(value) if re.fullmatch(r"-?\d+", value) else 0

        return cls(str(given.get("allows") or "services"), number("size_min"), number("size_max"), words("locations"), words("verticals"))

    @property
    def live(self) -> tuple[str, ...]:
        asked = {"kind": self.allows == "services", "size": self.size_min or self.size_max, "location": self.locations, "vertical": self.verticals}
        return tuple(g for g in GATES if asked[g])

    def narrowed(self, other: Profile) -> Profile:
        """Both profiles at once: the higher floor, the lower ceiling, the shared terms (or one list where they share none)."""
        ceilings = [x for x in (self.size_max, other.size_max) if x]
        shared = lambda a, b: tuple(x for x in a if any(set(vocab.variants(x)) & set(vocab.variants(y)) for y in b)) or a or b
        return Profile(self.allows, max(self.size_min, other.size_min), min(ceilings, default=0), shared(self.locations, other.locations), shared(self.verticals, other.verticals))


def reachable(evidence: str, gates: tuple[str, ...], grade: str) -> bool:
    """Whether a rung can judge text of a grade: a rung of fetched pages, and any that asks for the vertical, needs fetched text."""
    return grade == "fetched" or not (evidence == "fetched" or "vertical" in gates)


def check_ladder(ladder: tuple[tuple[str, str, tuple[str, ...]], ...]) -> None:
    """Raises on a ladder whose rungs lack a name or gates, repeat none of the known ones, or name an unknown grade."""
    for at, (name, evidence, gates) in enumerate(ladder):
        wrong = "no name" if not name.strip() else f"grade {evidence!r}" if evidence not in ("snippet", "fetched") else "no gates" if not gates else next((f"gate {g!r}" for g in gates if g not in GATES), None)
        if wrong:
            raise ValueError(f"rung {at}: {wrong}")


def _count(text: Column, terms: tuple[str, ...]) -> Column:
    return F.size(T.matches(text, terms))


_COUNTED = {
    "n_hard_directory": vocab.HARD_DIRECTORY_TERMS, "n_soft_directory": vocab.SOFT_DIRECTORY_TERMS, "n_software": vocab.SOFTWARE_TERMS, "n_hard_software": vocab.HARD_SOFTWARE_TERMS,
    "n_services": vocab.SERVICES_TERMS, "n_primary": vocab.PRIMARY_SERVICES_TERMS, "n_delivery": vocab.DELIVERY_TERMS,
}


def readings(candidates: DataFrame, *, text: str = "text") -> DataFrame:
    """``candidates`` with what their text says: kind, size, place, verticals, n_delivery. Columns of those names are replaced."""
    t = F.col(text)
    counted = candidates.withColumns({name: _count(t, terms) for name, terms in _COUNTED.items()})
    read = counted.withColumns({"kind": _kind(), "size": read_size(t), "place": read_location(t), "verticals": read_verticals(t)})
    return read.drop(*[n for n in _COUNTED if n != "n_delivery"])


def _kind() -> Column:
    """services, software, directory, or empty when the text says neither; from the counts of what it says."""
    software, services, primary = F.col("n_software"), F.col("n_services"), F.col("n_primary")
    product_company = (software > 0) & (((F.col("n_hard_software") > 0) & ~((primary >= 2) & (services > software))) | (primary == 0) | (software > services))
    return (
        F.when((F.col("n_hard_directory") > 0) | ((F.col("n_soft_directory") > 0) & (primary == 0)), "directory")
        .when(product_company, "software").when(services > 0, "services").otherwise("")
    )


def read_size(text: Column) -> Column:
    """The headcount that the text states, by the first pattern that matches; null if none does."""
    return F.coalesce(*[F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("int") for p in vocab.SIZE_PATTERNS])


def read_location(text: Column) -> Column:
    """The place after "based in" and the like, else the first known place the text names; empty if none."""
    stated = F.nullif(F.regexp_replace(F.trim(F.regexp_extract(text, vocab.LOCATION_PATTERN, 1)), ",$", ""), F.lit(""))
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [F.when(F.contains(low, F.lit(v)), F.lit(v.title())) for place in vocab.PLACES for v in vocab.variants(place)]
    return F.coalesce(stated, *named, F.lit(""))


def read_verticals(text: Column) -> Column:
    return T.matches(text, vocab.VERTICALS)


def _result(gate: str, outcome: Column, reason: Column, grade: Column | str) -> Column:
    return F.struct(F.lit(gate).alias("gate"), outcome.alias("outcome"), reason.alias("reason"), (F.lit(grade) if isinstance(grade, str) else grade).alias("evidence"))


def check_kind(text: Column, grade: Column) -> Column:
    """These checks judge the columns of ``readings``."""
    kind, fetched = F.col("kind"), grade == "fetched"
    mute = fetched & (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.col("n_delivery") == 0)
    outcome = F.when(kind.isin("software", "directory"), "fail").when((kind == "services") & fetched, "pass").when(kind == "services", "unknown").when(mute, "fail").otherwise("unknown")
    reason = (
        F.when(kind == "software", "reads as a product company, not a delivery firm").when(kind == "directory", "reads as a directory of companies")
        .when((kind == "services") & fetched, "reads as a delivery firm").when(kind == "services", "snippet reads as a delivery firm; only a page can confirm it")
        .when(mute, "nothing on the page reads as a delivery firm: no services, no clients, no delivery language at all").otherwise("nothing here says what kind of company it is")
    )
    return _result("kind", outcome, reason, grade)


def check_size(p: Profile, grade: Column) -> Column:
    size = F.col("size")
    low = (size < p.size_min) if p.size_min else F.lit(False)
    high = (size > p.size_max) if p.size_max else F.lit(False)
    outcome = F.when(size.isNull(), "unknown").when(low | high, "fail").otherwise("pass")
    people = F.concat(size.cast("string"), F.lit(" people is "))
    reason = (
        F.when(size.isNull(), "no headcount stated anywhere we have read").when(low, F.concat(people, F.lit(f"below the profile's floor of {p.size_min}")))
        .when(high, F.concat(people, F.lit(f"above the profile's ceiling of {p.size_max}"))).otherwise(F.concat(people, F.lit("within the profile's range")))
    )
    return _result("size", outcome, reason, grade)


def check_location(p: Profile, grade: Column) -> Column:
    place = F.col("place")
    inside = F.size(T.matches(place, p.locations)) > 0
    outcome = F.when(place == "", "unknown").when(inside, "pass").otherwise("fail")
    reason = F.when(place == "", "no location stated anywhere we have read").when(inside, F.concat(F.lit("in territory ("), place, F.lit(")"))).otherwise(F.concat(place, F.lit(" is outside the profile's territory")))
    return _result("location", outcome, reason, grade)


def check_vertical(p: Profile, grade: Column) -> Column:
    """Industries count only on a page that was read; on a snippet the gate stays unknown."""
    named = F.array_join(F.when(grade == "fetched", F.col("verticals")).otherwise(F.array().cast("array<string>")), ", ")
    wanted = T.matches(named, p.verticals)
    outcome = F.when(named == "", "unknown").when(F.size(wanted) > 0, "pass").otherwise("fail")
    reason = (
        F.when(named == "", "verticals are not visible yet; they live in the case studies").when(F.size(wanted) > 0, F.concat(F.lit("serves "), F.array_join(wanted, ", ")))
        .otherwise(F.concat(F.lit("serves "), F.array_join(F.array_sort(F.split(named, ", ")), ", "), F.lit(" and none of the profile's verticals")))
    )
    return _result("vertical", outcome, reason, grade)


def funnel(candidates: DataFrame, profile: Profile, *, text: str = "text", evidence: str = "evidence") -> DataFrame:
    """``candidates`` and ``results``: the trace of live gates up to and with the first failure."""
    t, g = F.col(text), F.coalesce(F.col(evidence), F.lit("snippet"))
    checks = {"kind": lambda: check_kind(t, g), "size": lambda: check_size(profile, g), "location": lambda: check_location(profile, g), "vertical": lambda: check_vertical(profile, g)}
    every = [checks[gate]() for gate in profile.live]
    if not every:
        return candidates.withColumn("results", F.array().cast("array<struct<gate: string, outcome: string, reason: string, evidence: string>>"))
    own = readings(candidates, text=text).withColumn("results", F.array(*every)).drop("kind", "size", "place", "verticals", "n_delivery")
    stop = F.array_position(F.transform("results", lambda r: r.outcome), "fail").cast("int")
    return own.withColumn("results", F.when(stop > 0, F.slice("results", 1, stop)).otherwise(F.col("results")))


def verdict(results: Column) -> Column:
    """eliminated after a failure, qualified if every gate passed and there was one, else lead."""
    return F.when(F.exists(results, lambda r: r.outcome == "fail"), "eliminated").when((F.size(results) > 0) & F.forall(results, lambda r: r.outcome == "pass"), "qualified").otherwise("lead")


def because(results: Column) -> Column:
    """The first failing gate's reason, else the gates still open."""
    failed = F.filter(results, lambda r: r.outcome == "fail")
    open_ = F.transform(F.filter(results, lambda r: r.outcome == "unknown"), lambda r: r.gate)
    return F.when(F.size(failed) > 0, F.element_at(failed, 1)["reason"]).when(F.size(open_) > 0, F.concat(F.lit("unresolved: "), F.array_join(open_, ", "))).otherwise("")


def open_gates(results: Column) -> Column:
    return F.transform(F.filter(results, lambda r: r.outcome == "unknown"), lambda r: r.gate)


def earned(open_: tuple[str, ...], fetched: bool, ladder=vocab.LADDER) -> str:
    """The first rung that settles something open which the evidence at hand can't: a page for a snippet, case studies for a vertical."""
    for name, grade, gates in ladder:
        if any(g in open_ for g in gates) and grade == "fetched" and (not fetched or "vertical" in gates):
            return name
    return ""


def earned_table(spark: SparkSession, ladder=vocab.LADDER) -> DataFrame:
    """(open, fetched, earned) for every set of open gates: 2 x 16 rows, a proven bound, so it may be broadcast."""
    rows = []
    for flags in product((False, True), repeat=len(GATES)):
        open_ = tuple(g for g, f in zip(GATES, flags, strict=True) if f)
        rows += [(",".join(open_), fetched, earned(open_, fetched, ladder)) for fetched in (False, True)]
    return spark.createDataFrame(rows, "open string, fetched boolean, earned string")


def rung_rows(candidates: DataFrame, profile: Profile, **names) -> DataFrame:
    """The rung table: candidates with verdict, because, open, earned and whether they advance; the eliminated stay in it."""
    own = funnel(candidates, profile, **names)
    own = own.withColumns({"verdict": verdict(F.col("results")), "because": because(F.col("results")), "open": F.array_join(open_gates(F.col("results")), ",")})
    own = own.withColumn("fetched", F.coalesce(F.col(names.get("evidence", "evidence")) == "fetched", F.lit(False)))
    table = F.broadcast(earned_table(candidates.sparkSession))
    joined = own.join(table, ["open", "fetched"], "left").withColumn("earned", F.when(F.col("verdict") == "eliminated", "").otherwise(F.coalesce("earned", F.lit(""))))
    return joined.withColumn("advances", (F.col("verdict") != "eliminated") & (F.col("earned") != ""))
