"""Delimited tables: profile, advice on how they become documents, and the documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import compact_ws, looks_numeric, row_to_text

# Parts of column names that tell a column's role.
ID_TOKENS = ("assetnum", "asset", "pk", "codigo", "id")
MEASURE_TOKENS = ("abonado", "descuento", "recargo", "precio", "importe", "total", "cantidad", "valor")
TEMPORAL_TOKENS = ("fecha", "periodo")
NARRATIVE_TOKENS = ("descripcion", "descrip", "horario", "equipamiento", "trans", "audiencia", "texto", "url", "titulo", "contenido", "estado")
# Columns that hold a place's district and neighbourhood.
DISTRICT, NEIGHBORHOOD = ("nombre_dis", "distrito"), ("nombre_bar", "barrio")
#: Treatment and dedup policy of each kind, and the hint for the splitter.
KINDS = {
    "entity_table": ("entity_doc", "exact_key", "no_chunk"),
    "fact_table": ("grouped_doc", "group_only", "light_chunk"),
    "time_series": ("grouped_doc", "group_only", "light_chunk"),
    "textual_table": ("row_as_doc", "semantic_optional", "normal_chunk"),
    "unknown_csv": ("row_as_doc", "exact_only", "normal_chunk"),
    "tabular_txt": ("row_as_doc", "exact_only", "normal_chunk"),
}


@dataclass(frozen=True)
class Profile:
    source: str
    columns: list[str]
    n_rows: int
    id_columns: list[str]
    measure_columns: list[str]
    temporal_columns: list[str]
    narrative_columns: list[str]
    numeric_ratio: float
    narrative_ratio: float
    avg_row_chars: float
    uniqueness_ratio: float
    numeric_col_ratios: dict[str, float]
    top_cardinality: dict[str, int]

    @property
    def n_cols(self) -> int:
        return len(self.columns)

    @property
    def has_date_column(self) -> bool:
        return bool(self.temporal_columns)


@dataclass(frozen=True)
class Advice:
    source: str
    csv_kind: str
    id_columns: list[str] = field(default_factory=list)
    measure_columns: list[str] = field(default_factory=list)
    grouping_keys: list[str] = field(default_factory=list)
    confidence: float = 0.4
    reason: str = ""

    @property
    def treatment(self) -> str:
        return KINDS[self.csv_kind][0]

    @property
    def dedup_policy(self) -> str:
        return KINDS[self.csv_kind][1]


@dataclass(frozen=True)
class Recipe:
    """Fixed advice for a known source, if the columns that it names are there."""

    csv_kind: str
    reason: str
    id_columns: tuple[str, ...] = ()
    grouping_keys: tuple[str, ...] = ()
    measure_columns: tuple[str, ...] = ()


_PLACES = Recipe("entity_table", "places with a stable key", ("pk",))
#: The known files of the original corpus.
RECIPES = {
    "200186-0-polideportivos.csv": _PLACES,
    "200215-0-instalaciones-deportivas.csv": _PLACES,
    "210227-0-piscinas-publicas.csv": _PLACES,
    "300390-0-areas-deportivas.csv": Recipe("entity_table", "areas with a stable key", ("mxassetnum",)),
    "212504-0-agenda-actividades-deportes.csv": Recipe("entity_table", "events with a stable key", ("id-evento",)),
    "300085-0-deportes_abonos.csv": Recipe("fact_table", "a row for each subscriber", (), ("mes", "centro deportivo", "tipo de abono"), ("nº de abonados",)),
    "300097-0-deportes-descuentos.csv": Recipe("fact_table", "a row for each discount", (), ("grupo descuento/recargo", "mes", "centro deportivo", "distrito"), ("nº descuentos",)),
}


def with_role(columns: Sequence[str], tokens: Sequence[str]) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in tokens)]


def _text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns), F.col("_row").cast("long").alias("_row"))


def profile_row(df: DataFrame, order: str, sample: int = 2000, ratio_sample: int = 1000) -> DataFrame:
    """One row of counts over the first `sample` rows by `order`: for each column the values, numbers and distinct values among the first `ratio_sample` rows, and the rows, distinct rows and characters. All in one aggregate."""
    columns = [c for c in df.columns if c != order]
    head = _text(df.withColumn("_row", F.col(order)).orderBy(order).limit(sample), columns)
    # the window is over the sample only
    head = head.withColumn("_early", F.row_number().over(Window.orderBy("_row")) <= ratio_sample)
    line = F.concat_ws("|", *(F.col(f"`{c}`") for c in columns))
    aggs = [F.count("*").alias("n_rows"), F.count_distinct(F.md5(line.cast("binary"))).alias("n_distinct"), F.sum(F.length(line)).alias("n_chars")]
    for i, c in enumerate(columns):
        filled = F.when(F.col("_early") & (F.col(f"`{c}`") != ""), F.col(f"`{c}`"))
        aggs += [F.count(filled).alias(f"filled_{i}"), F.count_if(looks_numeric(filled)).alias(f"numeric_{i}"), F.count_distinct(filled).alias(f"distinct_{i}")]
    return head.agg(*aggs)


def profile_table(df: DataFrame, source: str, order: str, sample: int = 2000) -> Profile:
    """The profile of a table whose columns are df's, less `order`; the driver sees one row of counts."""
    columns = [c for c in df.columns if c != order]
    row = profile_row(df, order, sample).first()
    counts = {c: (row[f"filled_{i}"], row[f"numeric_{i}"], row[f"distinct_{i}"]) for i, c in enumerate(columns)}
    return profile_of(source, columns, row.n_rows, row.n_distinct, row.n_chars or 0, counts)


def profile_of(source: str, columns: list[str], n: int, n_distinct: int, n_chars: int, counts: Mapping[str, tuple[int, int, int]]) -> Profile:
    """The profile that follows from a table's counts of rows, distinct rows and characters, and each column's (values, numbers, distinct values)."""
    ratios = {c: counts[c][1] / counts[c][0] for c in columns if counts[c][0]}
    share = lambda x, of: x / of if of else 0.0
    narrative = with_role(columns, NARRATIVE_TOKENS)
    return Profile(
        source, columns, n, with_role(columns, ID_TOKENS), [c for c in with_role(columns, MEASURE_TOKENS) if ratios.get(c, 0.0) >= 0.5], with_role(columns, TEMPORAL_TOKENS), narrative,
        round(share(sum(r >= 0.5 for r in ratios.values()), len(ratios)), 3), round(share(len(narrative), len(columns)), 3), round(share(n_chars, n), 1), round(share(n_distinct, n), 3),
        ratios, {c: counts[c][2] for c in columns if c in ratios},
    )


def match_recipe(profile: Profile, recipes: Mapping[str, Recipe] = RECIPES) -> Advice | None:
    recipe = recipes.get(profile.source)
    if recipe is None or not {*recipe.id_columns, *recipe.grouping_keys, *recipe.measure_columns} <= set(profile.columns):
        return None
    return Advice(profile.source, recipe.csv_kind, list(recipe.id_columns), list(recipe.measure_columns), list(recipe.grouping_keys), 0.99, recipe.reason)


def _dimensions(profile: Profile) -> list[str]:
    out = {*profile.measure_columns, *profile.id_columns}
    return [c for c in profile.columns if c not in out and c not in profile.narrative_columns]


def grouping_keys(profile: Profile) -> list[str]:
    """Temporal columns, then other dimensions, four at most."""
    out = {*profile.measure_columns, *profile.id_columns}
    return list(dict.fromkeys([*(c for c in profile.temporal_columns if c not in out), *_dimensions(profile)]))[:4]


def infer_kind(profile: Profile) -> Advice:
    narrative = len(profile.narrative_columns) / profile.n_cols if profile.n_cols else 0.0
    first_id, first_measure = profile.id_columns[:1], profile.measure_columns[:1]
    if profile.id_columns and profile.n_cols >= 3 and not profile.temporal_columns:
        return Advice(profile.source, "entity_table", profile.id_columns[:2], first_measure, [], 0.8, "stable id and no period")
    if profile.measure_columns and len(_dimensions(profile)) >= 3 and narrative < 0.3:
        kind, sure = ("time_series", 0.85) if profile.has_date_column else ("fact_table", 0.75)
        return Advice(profile.source, kind, first_id, first_measure, grouping_keys(profile), sure, "measures and dimensions")
    if profile.avg_row_chars > 250 or len(profile.narrative_columns) >= 2 or narrative >= 0.5:
        return Advice(profile.source, "textual_table", first_id, first_measure, [], 0.65, "rows of text")
    return Advice(profile.source, "unknown_csv", first_id, first_measure, [], 0.4, "not recognised")


def advise(profile: Profile, recipes: Mapping[str, Recipe] = RECIPES) -> Advice:
    return match_recipe(profile, recipes) or infer_kind(profile)


def _first_filled(names: Sequence[str], present: Sequence[str]) -> Column:
    cells = [F.nullif(compact_ws(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in present]
    return F.coalesce(*cells, F.lit("")) if cells else F.lit("")


def _described(df: DataFrame, advice: Advice) -> DataFrame:
    hint = KINDS[advice.csv_kind][2]
    return df.withColumns({"source": F.lit(advice.source), "csv_kind": F.lit(advice.csv_kind), "dedup_policy": F.lit(advice.dedup_policy), "chunking_hint": F.lit(hint)})


def entity_docs(df: DataFrame, advice: Advice, order: str) -> DataFrame:
    """A document for each row, with its entity_key, district and neighborhood."""
    columns = [c for c in df.columns if c != order]
    out = df.select(F.col(order).alias("row"), row_to_text(columns).alias("page_content"), _first_filled(advice.id_columns, columns).alias("entity_key"), _first_filled(DISTRICT, columns).alias("district"), _first_filled(NEIGHBORHOOD, columns).alias("neighborhood"))
    return _described(out, advice)


def grouped_docs(df: DataFrame, advice: Advice, order: str) -> DataFrame:
    """A document for each group of equal keys: a heading, the keys that are not empty, then a line for each row in input order. `row` is the group's first row."""
    names = advice.grouping_keys
    rest = [c for c in df.columns if c != order and c not in names]
    keyed = df.select(F.col(order).alias("_at"), *(compact_ws(F.col(f"`{k}`").cast("string")).alias(f"_k{i}") for i, k in enumerate(names)), F.nullif(row_to_text(rest), F.lit("")).alias("_line"))
    keys = [f"_k{i}" for i in range(len(names))]
    groups = keyed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("_lines"), F.count("*").cast("int").alias("group_size"), F.min("_at").alias("row"))
    shown = F.concat_ws("\n", F.lit(f"Resumen del dataset {advice.source}."), *(F.when(F.col(k) != "", F.concat(F.lit(f"{n}: "), F.col(k))) for k, n in zip(keys, names, strict=True)))
    body = F.array_join(F.transform("_lines", lambda e: F.concat(F.lit("\n- "), e["_line"])), "")
    text = F.concat(shown, F.lit("\n"), body)
    label = F.concat_ws("|", *(F.nullif(F.col(k), F.lit("")) for k in keys))
    out = groups.select("row", text.alias("page_content"), label.alias("group_key"), "group_size", F.lit(True).alias("is_aggregated"))
    return _described(out, advice)


def row_docs(df: DataFrame, advice: Advice, order: str) -> DataFrame:
    """A document for each row."""
    columns = [c for c in df.columns if c != order]
    return _described(df.select(F.col(order).alias("row"), row_to_text(columns).alias("page_content")), advice)


def transform_table(df: DataFrame, source: str, order: str, recipes: Mapping[str, Recipe] = RECIPES) -> DataFrame:
    """Profile, advise, and turn into documents; grouping without keys falls through to rows."""
    advice = advise(profile_table(df, source, order), recipes)
    if advice.treatment == "entity_doc":
        return entity_docs(df, advice, order)
    return grouped_docs(df, advice, order) if advice.treatment == "grouped_doc" and advice.grouping_keys else row_docs(df, advice, order)
