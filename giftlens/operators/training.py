"""Exposure-corrected training frame.

    selections --clean--> A1 groups --join exposure--> selected rows
    employees ⋈ company-shop links ⋈ catalog × {male, female}
        --anti-join selected keys--> zero rows --join first gift features-->
    selected rows ∪ zero rows

"First" means first in event order: every operator takes ``order_col``, an
orderable column (number, timestamp or struct) standing for file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftlens import constants as K

ORDER = "event_seq"
#: The group keys for sorts: gifts first, because their first bytes decide nearly every comparison.
SORT_KEYS = ["gift_id", "company_cvr", "employee_gender", "shop_id"]


def _product_or_missing(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(K.MISSING)


def exposure_for(gender: Column, male: Column, female: Column) -> Column:
    """Pick the head count of the employee's gender (null for other genders)."""
    return F.when(gender == "male", male).when(gender == "female", female)


def safe_rate(count: Column, exposure: Column) -> Column:
    """count / exposure, 0 when exposure is not positive (never divides by 0)."""
    return F.when(exposure > 0, count / exposure).otherwise(F.lit(0.0))


def selection_groups(selections: DataFrame, order_col: str = ORDER,
                     non_null: bool = False, products: bool = True) -> DataFrame:
    """A1: events per (shop, company, gift, gender) with the first non-null value
    of each product column in event order. Also carries ``first_seq`` and
    ``first_row`` (the group's first event, whole row) so gift features can be
    derived from the groups instead of re-reading the events.

    ``non_null=True`` (product columns known to hold no nulls, e.g. after
    cleaning) takes every column from the first row: one aggregate instead of
    one per column. So does a schema without nullable product columns, where an
    event without order value still counts as no first value. ``products=False``:
    keys and counts alone, for frames whose product columns nobody reads."""
    if not products:
        return selections.groupBy(*SORT_KEYS).agg(F.count(F.lit(1)).alias("selection_count")).select(*K.GROUP_KEYS, "selection_count")
    prods = [_product_or_missing(selections, c).alias(c) for c in K.PRODUCT_COLUMNS]
    plain = selections.select(*K.GROUP_KEYS, *prods, F.col(order_col).alias("_seq"))
    # the other keys and the product columns travel as one value each: the shuffle, the sort and the aggregates copy
    # two values a row instead of eleven
    df = plain.select("gift_id", F.struct(*SORT_KEYS[1:]).alias("_keys"), F.struct(*K.PRODUCT_COLUMNS).alias("row"), "_seq")
    df = df.repartition("gift_id", "_keys")  # every aggregate below uses this shuffle and its own one sort
    if non_null:
        # the same events as (keys, product columns) first, with the first order value that is not null
        df = df.groupBy("gift_id", "_keys", "row").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_seq"))
    aggs = [(F.sum("_n") if non_null else F.count(F.lit(1))).alias("selection_count"),
            F.min(F.struct("_seq", "row")).alias("_first")]
    source = "_first.row."
    if not non_null and any(plain.schema[c].nullable for c in K.PRODUCT_COLUMNS):
        source = "_nn_"
        aggs += [F.min_by(F.col("row." + c), F.when(F.col("row." + c).isNotNull(), F.col("_seq"))).alias("_nn_" + c)
                 for c in K.PRODUCT_COLUMNS]
    elif not non_null:
        source = "_row."
        aggs.append(F.min_by("row", "_seq").alias("_row"))
    g = df.groupBy("gift_id", "_keys").agg(*aggs)
    keys = [F.col(c if c == "gift_id" else "_keys." + c).alias(c) for c in K.GROUP_KEYS]
    return g.select(*keys, "selection_count", *[F.col(source + c).alias(c) for c in K.PRODUCT_COLUMNS],
                    F.col("_first._seq").alias("first_seq"), F.col("_first.row").alias("first_row"))


def first_employee_row(employees: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per company, the first in ``order_col`` order (file order
    when the column is absent: ``monotonically_increasing_id`` at the scan)."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    df = employees.select("company_cvr", "male_count", "female_count", order.alias("_o"))
    return (df.groupBy("company_cvr")
            .agg(F.min_by(F.struct("male_count", "female_count"), F.col("_o")).alias("_e"))
            .select("company_cvr", F.col("_e.male_count").alias("male_count"),
                    F.col("_e.female_count").alias("female_count")))


def training_selected(groups: DataFrame, employees: DataFrame,
                      employees_order: str | None = None) -> DataFrame:
    """Selected rows with exposure from the company's first employee row.
    Unknown companies and genders other than male/female are dropped
    (see :func:`selection_rejects`)."""
    # One row per company; AQE turns this into a broadcast join from the measured
    # size of the aggregated side (no hint, no extra counting job).
    emp = first_employee_row(employees, employees_order)
    exposure = exposure_for(F.col("employee_gender"), F.col("male_count"), F.col("female_count"))
    return (groups.filter(F.col("employee_gender").isin(K.GENDERS))
            .join(emp, "company_cvr")
            .select(*K.GROUP_KEYS,
                    F.col("selection_count").cast("long").alias("selection_count"),
                    exposure.cast("double").alias("exposure"),
                    safe_rate(F.col("selection_count"), exposure).cast("double").alias("selection_rate"),
                    *[c for c in K.PRODUCT_COLUMNS if c in groups.columns]))


def selection_rejects(groups: DataFrame, employees: DataFrame) -> DataFrame:
    """Groups left out of the training frame, with the reason."""
    emp = employees.select("company_cvr").distinct()
    known = groups.join(emp.withColumn("_known", F.lit(True)), "company_cvr", "left")
    reason = (F.when(~F.col("employee_gender").isin(K.GENDERS), F.lit("gender"))
              .when(F.col("_known").isNull(), F.lit("unknown_company")))
    return (known.select(*K.GROUP_KEYS, "selection_count", reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def gift_first_features(groups: DataFrame) -> DataFrame:
    """Product columns of the first event of each gift (whole row; without
    ``first_row`` the groups' own product columns are that row)."""
    cols = K.PRODUCT_COLUMNS if "first_row" in groups.columns else [c for c in K.PRODUCT_COLUMNS if c in groups.columns]
    row = F.col("first_row") if "first_row" in groups.columns else F.struct(*cols)
    return (groups.groupBy("gift_id")
            .agg(F.min_by(row, F.col("first_seq")).alias("_r"))
            .select("gift_id", *[F.col("_r." + c).alias(c) for c in cols]))


def company_shop_links(selections: DataFrame) -> DataFrame:
    """(company, shop) pairs a company is exposed to: the shops it selected in
    (accepts events or their groups)."""
    return selections.select("company_cvr", "shop_id").distinct()


def exposure_universe(employees: DataFrame, catalog: DataFrame, links: DataFrame) -> DataFrame:
    """Every employee row × the catalog of each shop linked to its company ×
    {male, female}, with the row's own head count as exposure. Built from
    equi-joins (company, shop); the gender fan-out is an ``explode``."""
    return _universe_of(_exposed_pairs(employees, links), catalog)


def _exposed_pairs(employees: DataFrame, links: DataFrame) -> DataFrame:
    emp = employees.select("company_cvr", "male_count", "female_count")
    return emp.join(links.select("company_cvr", "shop_id"), "company_cvr")


def _universe_of(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    u = pairs.join(catalog.select("shop_id", "gift_id"), "shop_id")
    u = u.withColumn("employee_gender", F.explode(F.array(*[F.lit(g) for g in K.GENDERS])))
    exposure = exposure_for(F.col("employee_gender"), F.col("male_count"), F.col("female_count"))
    return u.select(*K.GROUP_KEYS, exposure.cast("double").alias("exposure"))


def zero_selection_rows(universe: DataFrame, groups: DataFrame, gift_features: DataFrame | None) -> DataFrame:
    """J4 + J5: universe rows without a selection, with first-seen gift features
    (``NONE`` for gifts never selected; ``gift_features=None``: no product columns)."""
    zeros = universe.join(groups.select(*SORT_KEYS), SORT_KEYS, "left_anti")
    z = zeros if gift_features is None else zeros.join(gift_features, "gift_id", "left")
    return z.select(*K.GROUP_KEYS,
                    F.lit(0).cast("long").alias("selection_count"),
                    F.col("exposure"),
                    F.lit(0.0).alias("selection_rate"),
                    *[F.coalesce(F.col(c), F.lit(K.MISSING)).alias(c) for c in K.PRODUCT_COLUMNS if c in z.columns])


def training_frame(selections: DataFrame, catalog: DataFrame, employees: DataFrame,
                   links: DataFrame | None = None, order_col: str = ORDER,
                   employees_order: str | None = None, clean: bool = True,
                   materialize: bool = True, products: list[str] | None = None) -> DataFrame:
    """M1: the exposure-corrected training frame (selected rows ∪ zero rows).

    ``links`` lists the (company_cvr, shop_id) pairs whose catalogs form each
    company's zero-selection universe; by default the shops the company selected
    in. Pass every (company, shop) pair to pair each company with all catalogs.
    ``products`` names the product columns that are read later (all by default): the
    rows are the same, the others are neither carried nor stored.

    See :func:`training_parts` for the two halves.
    """
    _, selected, zeros = training_parts(selections, catalog, employees, links, order_col, employees_order, clean,
                                        materialize, products)
    return selected.unionByName(zeros)


def training_parts(selections: DataFrame, catalog: DataFrame, employees: DataFrame,
                   links: DataFrame | None = None, order_col: str = ORDER,
                   employees_order: str | None = None, clean: bool = True,
                   materialize: bool = True, products: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies of the frame, selected rows, zero rows) of :func:`training_frame`.

    The events are read once: their groups feed the selected rows, the
    anti-join keys, the links and the gift features. With ``materialize`` the
    groups are stored in the shared checkpoint folder so the three
    consumers do not re-aggregate the events; so are the company rows and the (company, shop) pairs,
    whose file sizes decide whether their joins are broadcasts.
    """
    from giftlens.functions.cleaning import clean_catalog, clean_employees, clean_selections
    if clean:
        selections = clean_selections(selections)
        catalog = clean_catalog(catalog)
        employees = clean_employees(employees)
    wanted = K.PRODUCT_COLUMNS if products is None else [c for c in K.PRODUCT_COLUMNS if c in products]
    groups = selection_groups(selections, order_col, non_null=clean, products=bool(wanted))
    if clean and wanted:  # the product columns are the first event's own
        groups = groups.select(*K.GROUP_KEYS, "selection_count", *wanted, "first_seq")
    if materialize:
        from giftlens.session import cut_lineage
        groups, employees, catalog = cut_lineage(groups), cut_lineage(employees), cut_lineage(catalog)
    selected = training_selected(groups, employees, employees_order)
    links = company_shop_links(groups) if links is None else links
    pairs = _exposed_pairs(employees, links)
    if materialize:
        pairs = cut_lineage(pairs)
    universe = _universe_of(pairs, catalog)
    # a company is in the frame through a selected row or through its universe; neither needs the frame itself
    exposed = (links.join(catalog.select("shop_id").distinct(), "shop_id", "left_semi")
               .join(employees.select("company_cvr"), "company_cvr", "left_semi").select("company_cvr"))
    companies = selected.select("company_cvr").unionByName(exposed).distinct()
    zeros = zero_selection_rows(universe, groups, gift_first_features(groups) if wanted else None)
    if wanted != K.PRODUCT_COLUMNS:
        kept = [*K.GROUP_KEYS, "selection_count", "exposure", "selection_rate", *wanted]
        selected, zeros = selected.select(*kept), zeros.select(*kept)
    return companies, selected, zeros
