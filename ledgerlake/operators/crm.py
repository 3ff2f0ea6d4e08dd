"""Team and leads: merged staff lists, opening and moving leads, what a lead shows, stages of the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.clients import money_text
from ledgerlake.operators.serving import assign
from ledgerlake.sources.staging import placed, staged

# Words that count as ticked; states in which a lead is open, and all of them.
TICKED = ("✅", "true", "True", "1", "yes", "YES")
LOCALE = "es"
#: Levels that a pass judges, and levels of a block of slots.
WIDE = 64
OPEN, STATES = ("new", "contacted", "meeting"), ("new", "contacted", "meeting", "closed")


def ticked(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin(*TICKED), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """A name-based id: the first 16 bytes of a SHA-1 with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def merge_sources(sources: list[DataFrame], key: str, line: str) -> DataFrame:
    """One row for each key: that of the earliest source, then line. Blank keys are skipped; n_repeats counts the rows
    that were passed over. A key with very many rows meets as one candidate of each task."""
    rows = None
    for k, df in enumerate(sources):
        part = df.withColumn("source", F.lit(k)).withColumn(key, F.trim(key)).where(F.coalesce(F.col(key) != "", F.lit(False)))
        rows = part if rows is None else rows.unionByName(part)
    first = F.min_by(F.struct(*(c for c in rows.columns if c != key)), F.struct("source", line)).alias("r")
    return rows.groupBy(key).agg(first, (F.count(F.lit(1)) - 1).alias("n_repeats")).select(key, "r.*", "n_repeats")


def fill_level(load: DataFrame, n: int) -> tuple[int, int]:
    """(level, filled) of load(employee_id, open_leads): the highest level up to which n leads fill all who are below it,
    and how many it takes. A pass judges WIDE levels at once, so that a few passes find it among any."""
    low = load.agg(F.min("open_leads")).first()[0]
    high = low + n  # that many fill the least loaded one alone to this level, and nobody higher
    while True:
        step = max(1, -(-(high - low) // WIDE))
        levels = list(range(low, high + 1, step))
        takes = load.agg(*(F.sum(F.greatest(F.lit(x) - F.col("open_leads"), F.lit(0))).alias(f"x{k}") for k, x in enumerate(levels))).first()
        at = max(k for k, t in enumerate(takes) if t <= n)
        if step == 1:
            return levels[at], takes[at]
        low, high = levels[at], min(high, levels[at] + step - 1)


def slots(load: DataFrame, n: int) -> DataFrame:
    """(employee_id, level, place): who gets the first, second, ... of n leads, each for the member with the fewest open
    leads then, the least id of equal ones.

    Leads one after another fill load as water would: the k-th goes to the k-th of all (level, id) at or above the loads. A
    member gets one at each level from their load up to the common one, and the first by id one more until n are dealt.
    """
    level, filled = fill_level(load, n)
    below = load.where(F.col("open_leads") < level)
    blocks = below.select("employee_id", "open_leads", F.explode(F.sequence(F.col("open_leads"), F.lit(level - 1), F.lit(WIDE))).alias("a"))
    full = blocks.select("employee_id", F.explode(F.sequence("a", F.least(F.col("a") + (WIDE - 1), F.lit(level - 1)))).alias("level"))
    more = placed(load.where(F.col("open_leads") <= level).select("employee_id"), F.col("employee_id").asc()).where(F.col("place") <= n - filled)
    return placed(full.unionByName(more.select("employee_id", F.lit(level).cast("long").alias("level"))), F.col("level").asc(), F.col("employee_id").asc())


def open_leads(leads: DataFrame, team: DataFrame, companies: DataFrame, draft: str, namespace: str) -> DataFrame:
    """For each of companies(company_id) its open lead, or a new one: lead_id, company_id, status, assigned_to, already_open.

    New leads are opened one after another by company, each for the member of the team with the fewest open leads then. The
    id of a new lead is made of the company and the number of its former leads, so none has the id of a closed one. Without
    a team nobody can be assigned, which is an error.
    """
    asked = companies.select("company_id").distinct()
    mine = leads.groupBy("company_id").agg(F.min_by(F.struct("lead_id", "status", "assigned_to"), F.when(F.col("status").isin(*OPEN), F.col("lead_id"))).alias("l"), F.max(F.col("status").isin(*OPEN)).alias("is_open"), F.count(F.lit(1)).alias("former"))
    met = staged(asked.join(mine, "company_id", "left"), "asked-companies")
    known = met.where("is_open").select("l.lead_id", "company_id", "l.status", "l.assigned_to", F.lit(True).alias("already_open"), F.lit(None).cast("string").alias("draft"))
    new = met.where("NOT coalesce(is_open, false)").select("company_id", F.coalesce("former", F.lit(0)).alias("former"))
    n = new.count()
    if not n:
        return known
    load = staged(assign(leads, team).select("employee_id", F.col("open_leads").cast("long").alias("open_leads")), "open-loads")
    if load.isEmpty():
        raise ValueError("no team to assign leads to")
    who = slots(load, n).select("place", F.col("employee_id").alias("assigned_to"))
    dealt = placed(new, F.col("company_id").asc()).join(who, "place")
    name = F.concat_ws(":", "company_id", "former")
    return known.unionByName(dealt.select(uuid5(namespace, name).alias("lead_id"), "company_id", F.lit("new").alias("status"), "assigned_to", F.lit(False).alias("already_open"), F.lit(draft).alias("draft")))


def judged(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(lead_id, status), each once, with why it can't be made, or null: an unknown status, an unknown lead, or
    another valid status for the same lead."""
    each = changes.select("lead_id", "status").distinct()
    known = F.coalesce(F.col("status").isin(*STATES), F.lit(False))
    wanted = each.groupBy("lead_id").agg(F.count_if(known).alias("n"))
    met = each.join(wanted, "lead_id", "left").join(leads.select("lead_id").distinct().withColumn("there", F.lit(True)), "lead_id", "left")
    why = F.when(~known, "unknown status").when(F.col("there").isNull(), "unknown lead").when(F.col("n") > 1, "several statuses")
    return met.select("lead_id", "status", why.alias("why"))


def with_status(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """leads with the status that changes(lead_id, status) give them; what judged() rejects changes nothing."""
    new = judged(leads, changes).where("why IS NULL").select("lead_id", F.col("status").alias("new_status"))
    return leads.join(new, "lead_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def rejected(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """(lead_id, status, why) of the changes that with_status() doesn't make; a caller reports these."""
    return judged(leads, changes).where("why IS NOT NULL")


def hydrated(leads: DataFrame, staff: DataFrame, names: DataFrame, forecast: DataFrame) -> DataFrame:
    """Leads as they are shown: who works on them, the company's name, and the amount that the forecast says is short."""
    gap = forecast.where("break_from is not null").select("company_id", money_text(F.abs(F.round("low", 0))).alias("amount"), "low_date", "rescue_date")
    out = leads.join(staff.select(F.col("employee_id").alias("assigned_to"), "name", "title"), "assigned_to", "left").join(names.select("company_id", "display_name"), "company_id", "left").join(gap, "company_id", "left")
    rest = F.when(F.col("rescue_date").isNotNull(), F.concat(F.lit("; covered on "), F.date_format("rescue_date", "yyyy-MM-dd"))).otherwise("")
    detail = F.when(F.col("amount").isNotNull(), F.concat(F.lit("short of "), F.col("amount"), F.lit(" on "), F.date_format("low_date", "yyyy-MM-dd"), rest))
    return out.select("lead_id", "company_id", F.coalesce("display_name", "company_id").alias("company_name"), "status", F.coalesce("name", F.lit("unassigned")).alias("assignee"), F.coalesce("title", F.lit("")).alias("assignee_title"), F.col("amount").alias("reason_amount"), detail.alias("reason_detail"))


def parsed_money(c: Column) -> Column:
    """The number of a text such as 62.231,50 €; nought for anything else."""
    digits = F.replace(F.replace(F.regexp_replace(c, r"[^\d.,]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def stages(shown: DataFrame) -> DataFrame:
    """(status, n, total) of each stage, empty ones included; no total where nothing adds up."""
    sums = F.array(*(F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("n"), F.nullif(F.coalesce(F.sum(F.when(F.col("status") == s, parsed_money(F.col("reason_amount")))), F.lit(0.0)), F.lit(0.0)).alias("total")) for s in STATES))
    return shown.agg(sums.alias("x")).select(F.inline("x"))


def team_counts(staff: DataFrame) -> DataFrame:
    return staff.groupBy("team").agg(F.count(F.lit(1)).alias("n"))


def table_order(rows: DataFrame, c: str, ascending: bool, tie: str) -> DataFrame:
    """rows with their place when sorted by c: rows without a value come last in either direction. Texts are in the order
    of LOCALE: accents and capitals count only between words that are else equal."""
    value = F.collate(F.col(c), LOCALE) if dict(rows.dtypes)[c].startswith("string") else F.col(c)
    by = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return placed(rows, by, F.col(tie).asc())
