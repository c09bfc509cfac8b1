"""``reconcile(source, target, spec)``: the whole comparison as one lazy plan.

Driver work is limited to name resolution and counters. Two passes come first: the
profile, and ``judge``, which counts every key and finds those that agree on both sides.
Every output is then a lazy DataFrame. Counts and missing rows come from the
judged keys; only keys that differ are paired, unless an output shows equal rows too
(``full_data``, ``flags``, ``paired``). ``ReconResult.write`` materialises the pairs that
differ once (Parquet under the session's checkpoint folder) and derives
every output from that copy, so a lost executor never recomputes the shuffle for
each output.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tally.operators import diff as D
from tally.operators import pair as P
from tally.operators import report as R
from tally.operators.judge import Judged, judge
from tally.operators.normalize import KEY, add_key, normalize_dates, normalize_keys, rename, stringify
from tally.operators.profile import Profile, profile_both
from tally.operators.names import q
from tally.operators.runs import SMALL_KEY_ROWS, expanded
from tally.session import scratch_path, spread_small
from tally.sources.files import write_table
from tally.spec import Alignment, ReconSpec, align, config_rows


@dataclass
class Prepared:
    spec: ReconSpec
    alignment: Alignment
    source: DataFrame           # normalised source rows with _key
    target: DataFrame           # normalised target rows (source names) with _key
    numeric: set[str]
    profile: Profile

    @property
    def labels(self) -> dict[str, str]:
        return {c: self.alignment.label(c) for c in self.alignment.compare}

    @property
    def dates(self) -> set[str]:
        """Columns treated as dates on either side, declared or detected."""
        return {c for d in (self.profile.source_dates, self.profile.target_dates) for c, x in d.items() if x.is_date}


def aligned_sides(source: DataFrame, target: DataFrame, spec: ReconSpec) -> tuple[Alignment, DataFrame, DataFrame]:
    """Aligned, stringified sides with keys normalised once (what profiling reads); small ones are written."""
    al = align(spec, source.columns, target.columns)
    scales = dict(spec.decimal_scales)
    side = lambda df, renames: spread_small(df, lambda d: normalize_keys(rename(stringify(d, scales), renames), al.keys))
    return al, side(source, al.source_renames), side(target, al.target_renames)


def prepare(source: DataFrame, target: DataFrame, spec: ReconSpec, *, numeric: set[str] | None = None) -> Prepared:
    """Everything before pairing. The profile decides date columns, formats and number columns of
    both sides; ``numeric`` overrides the last (the dates are profiled all the same)."""
    al, s, t = aligned_sides(source, target, spec)
    profile = profile_both(s, t, al.compare, al.keys, al.source_dates, al.target_dates, spec.auto_detect_dates)
    s, t = normalize_dates(s, profile.source_dates), normalize_dates(t, profile.target_dates)
    s, t = normalize_keys(s, al.keys), normalize_keys(t, al.keys)
    return Prepared(spec, al, add_key(s, al.keys), add_key(t, al.keys),
                    profile.numeric if numeric is None else numeric, profile)


@dataclass(frozen=True)
class ReconRecord:
    """What a written reconciliation came to."""
    source_rows: int
    target_rows: int
    matched: int
    missing_in_source: int
    missing_in_target: int
    surplus_in_source: int
    surplus_in_target: int
    records_affected: int
    cell_discrepancies: int
    per_column: dict[str, int]
    validation_issues: int
    status: str
    paths: dict[str, str]
    elapsed_seconds: float

    def __getitem__(self, name: str):
        return getattr(self, name)


@dataclass
class ReconResult:
    prepared: Prepared
    judged: Judged
    hot: DataFrame | None = None        # keys of the spread path
    stored: DataFrame | None = None     # pairs with flags, written once
    complete: bool = True               # False: ``stored`` holds only pairs that differ
    counted: dict | None = None         # the counters of differences, if they were taken already

    #: Share of all rows from which on pairing everything is cheaper than leaving out what agrees.
    FILTER_SHARE = 0.5

    # -- shorthand ---------------------------------------------------------
    @property
    def spec(self) -> ReconSpec:
        return self.prepared.spec

    @property
    def al(self) -> Alignment:
        return self.prepared.alignment

    def fl(self) -> dict:
        """Per-column difference flags, as columns of the pairs."""
        return D.stored_flags(self.prepared.alignment.compare)

    # -- pairs -------------------------------------------------------------
    def _pairs(self, every: bool) -> DataFrame:
        """Runs of pairs with their flags: of every key, or of all that may hold a difference."""
        if self.stored is not None:
            if every and not self.complete:
                raise ValueError("equal rows were not kept: set include_full_data")
            return self.stored
        p, n = self.prepared, self.judged.counts
        source, target, hot, unique = p.source, p.target, self.hot, n["most"] <= 1
        if not every and n["open_rows"] < self.FILTER_SHARE * (n["source_rows"] + n["target_rows"]):
            keys, unique = self.judged.two_sided(), not self.judged.has_duplicates
            hot = None if hot is None else hot.join(keys, KEY, "left_semi")
            source, target = P.only_keys(source, keys, hot), P.only_keys(target, keys, hot)
        carried = list(dict.fromkeys([*self.al.compare, *self.al.context]))
        pairs = P.pair_rows(source, target, carried, self.al.compare, self.al.order_by, hot, unique, n["most_rows"] <= SMALL_KEY_ROWS)
        return D.add_flags(pairs, self.al.compare, p.numeric, self.spec.case_sensitive)

    @property
    def paired(self) -> DataFrame:
        """One row per (key, position), equal rows included: what every other output is defined on."""
        return expanded(self._pairs(every=True) if self.stored is None else self.stored)

    def _missing(self, rows: DataFrame, side: str) -> DataFrame:
        """Rows of a side whose key the other side lacks: no positions are needed for them."""
        keys = self.judged.one_sided(side)
        return P.only_keys(rows, keys, None if self.hot is None else self.hot.join(keys, KEY, "left_semi"))

    # -- outputs -----------------------------------------------------------
    def cells(self) -> DataFrame:
        """Differing cells with internal (_key, _rn) columns."""
        return D.cells(self._pairs(False), self.fl(), self.prepared.labels, self.al.context, self.spec.value_label)

    def discrepancies(self) -> DataFrame:
        return self.cells().drop(KEY, P.RN)

    def report(self) -> DataFrame:
        return R.discrepancy_report(self.cells(), self.al.keys, self.al.include, self.spec.value_label,
                                    self.spec.comment_columns)

    def missing_in_target(self, comments: bool = False) -> DataFrame:
        df = self._missing(self.prepared.source, "source").select(*[q(c) for c in self.al.source_columns])
        return R.with_comments(df, self.spec.comment_columns) if comments else df

    def missing_in_source(self, comments: bool = False) -> DataFrame:
        df = self._missing(self.prepared.target, "target").select(*[q(c) for c in self.al.target_columns])
        return R.with_comments(df, self.spec.comment_columns) if comments else df

    def full_data(self) -> DataFrame:
        return R.full_data(expanded(self._pairs(True)), self.al.compare)

    def column_counts(self) -> DataFrame:
        return R.column_counts(self._pairs(False), self.fl(), self.prepared.labels)

    def totals(self) -> DataFrame:
        """One row: every counter of the summary."""
        known = [F.lit(self.judged.counts[c]).cast("bigint").alias(c) for c in R.COUNTERS if c != "records_affected"]
        if self.counted is not None:
            spark = self.prepared.source.sparkSession
            rest = spark.createDataFrame([tuple(self.counted.values())], ", ".join(f"{n} bigint" for n in self.counted))
        else:
            rest = self._pairs(False).agg(*R.difference_counters(self.fl()))
        return rest.select(*known, "*")

    def summary(self) -> DataFrame:
        spec = self.spec
        return R.summary(self.totals(), list(self.prepared.labels.values()), spec.source_label, spec.target_label,
                         spec.source_name, spec.target_name)

    def flags(self) -> DataFrame:
        return D.with_flags(expanded(self._pairs(True)), self.fl())

    def mismatched(self) -> DataFrame:
        return expanded(D.mismatched(self._pairs(False)))

    def columns_with_diffs(self) -> DataFrame:
        return R.columns_with_diffs(self._pairs(False), self.fl())

    def _partitions(self) -> int:
        return int(self.prepared.source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def top_n(self, n: int) -> DataFrame:
        rows = self if self.stored is not None or n <= R.MERGED_ROWS else self.materialize()
        return R.top_n(rows.cells(), self.al.keys, self.al.include, self.spec.value_label, n,
                       self.spec.comment_columns, self._partitions())

    def pages(self, page_rows: int, partitions: int | None = None) -> DataFrame:
        """The report with page numbers. Its pairs are written once: sorting over the cluster reads them more than once."""
        rows = self if self.stored is not None else self.materialize()
        return R.paginate(rows.cells(), self.al.keys, self.al.include, self.spec.value_label, page_rows,
                          partitions or self._partitions())

    def _counted_cells(self) -> int:
        return sum(n for c, n in self.counted.items() if c != "records_affected")

    def pages_of_a_task(self, page_rows: int) -> int:
        """How many files of ``write_pages`` come from one task (of a materialised result)."""
        return R.pages_of_a_task(self._counted_cells(), page_rows, self._partitions())

    def page_files(self, page_rows: int) -> DataFrame:
        """The report in partitions of whole pages of ``page_rows`` rows (the last may hold fewer), in order."""
        result = self if self.counted is not None else self.materialize()
        return R.page_files(result.cells(), self.al.keys, self.al.include, self.spec.value_label, page_rows,
                            self._partitions(), result._counted_cells(), self.spec.comment_columns)

    def write_pages(self, path: str, page_rows: int, fmt: str = "parquet") -> str:
        """Write the report in files of exactly ``page_rows`` rows, in report order by file name; only the last may be shorter."""
        write_table(self.page_files(page_rows), path, fmt, page_rows)
        return path

    def uncastable(self) -> DataFrame:
        """Per number column how many values are no numbers: they compare as blank, so two of them are equal (driver-sized)."""
        found = [(c, d.nonsentinel, d.nonsentinel - d.castable) for c, d in self.prepared.profile.numbers.items() if c in self.prepared.numeric]
        return self.prepared.source.sparkSession.createDataFrame(found, "column_name string, nonsentinel bigint, uncastable bigint")

    def configuration(self) -> DataFrame:
        """How every mapping was treated (one row per mapping; spec-sized)."""
        names, rows = config_rows(self.spec, self.al, self.prepared.dates)
        spark = self.prepared.source.sparkSession
        return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).coalesce(1)

    # -- sinks -------------------------------------------------------------
    def materialize(self, path: str | None = None) -> "ReconResult":
        """Write the pairs with their difference flags once (Parquet in the shared checkpoint
        folder) and return a result reading that copy: later outputs neither re-shuffle nor re-clean
        values. Pairs that are equal in every cell are written only for ``include_full_data``."""
        spark = self.prepared.source.sparkSession
        path = path or scratch_path(spark, f"paired-{uuid.uuid4().hex}")
        seen = Observation(f"paired-{uuid.uuid4().hex}")
        complete = self.complete and self.spec.include_full_data
        rows = self._pairs(complete).observe(seen, *R.difference_counters(self.fl()))
        if not complete:
            rows = D.mismatched(rows)
        rows.write.mode("overwrite").parquet(path)
        return ReconResult(self.prepared, self.judged, self.hot, spark.read.schema(rows.schema).parquet(path), complete, seen.get)

    def write(self, out_dir: str, fmt: str = "parquet", page_rows: int | None = None) -> ReconRecord:
        """Write every output (complete sets, no row cap; ``page_rows`` rows a file at most) as ``fmt``
        (parquet or csv) and return counts and paths.

        All or none: each run writes to a folder of its own in ``out_dir``, and when all outputs are there one
        row is added to the manifest. A run that fails adds none, so ``latest_outputs`` still names
        the outputs of the run before it. Folders of former and failed runs stay."""
        if fmt not in ("parquet", "csv"):
            raise ValueError(f"unknown output format {fmt!r}: parquet or csv")
        began = time.time()
        run = f"run-{time.strftime('%Y%m%dT%H%M%S', time.gmtime(began))}-{uuid.uuid4().hex[:8]}"
        result = self.materialize()
        outputs = {
            "discrepancies": result.report(),
            "missing_in_target": result.missing_in_target(comments=True),
            "missing_in_source": result.missing_in_source(comments=True),
            "summary": result.summary(),
            "configuration": result.configuration(),
        }
        if self.spec.include_full_data:
            outputs["full_data"] = result.full_data()
        paths = {}
        for name, df in outputs.items():
            paths[name] = f"{out_dir.rstrip('/')}/{run}/{name}"
            write_table(df, paths[name], fmt, page_rows)
        n = result.judged.counts | result.counted
        per_column = {label: n[f"n{i}"] for i, label in enumerate(self.prepared.labels.values())}
        cells = sum(per_column.values())
        record = ReconRecord(
            **{k: n[k] for k in ("source_rows", "target_rows", "matched", "missing_in_source", "missing_in_target",
                                 "surplus_in_source", "surplus_in_target", "records_affected")},
            cell_discrepancies=cells, per_column=per_column,
            validation_issues=n["missing_in_source"] + n["missing_in_target"] + cells,
            status=R.SOME_DIFFER if cells else R.ALL_MATCHED, paths=paths, elapsed_seconds=time.time() - began)
        commit_run(self.prepared.source.sparkSession, out_dir, run, began, record, fmt)
        return record


MANIFEST = "_manifest"
_MANIFEST_ROW = ("run string, began double, format string, status string, source_rows bigint, target_rows bigint, matched bigint, "
                 "cell_discrepancies bigint, validation_issues bigint, paths map<string, string>")


def commit_run(spark: SparkSession, out_dir: str, run: str, began: float, record: ReconRecord, fmt: str) -> None:
    """Add a finished run to the manifest: one file, which appears whole or not at all."""
    row = (run, began, fmt, record.status, record.source_rows, record.target_rows, record.matched, record.cell_discrepancies,
           record.validation_issues, record.paths)
    spark.createDataFrame([row], _MANIFEST_ROW).coalesce(1).write.mode("append").json(f"{out_dir.rstrip('/')}/{MANIFEST}")


def runs_in(spark: SparkSession, out_dir: str) -> DataFrame:
    """The finished runs of an output folder, one row each."""
    return spark.read.schema(_MANIFEST_ROW).json(f"{out_dir.rstrip('/')}/{MANIFEST}")


def latest_outputs(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Name → path of the outputs of the last finished run."""
    last = runs_in(spark, out_dir).orderBy(F.desc("began"), F.desc("run")).select("paths").first()
    if last is None:
        raise ValueError(f"no finished run in {out_dir}")
    return last["paths"]


def reconcile(source: DataFrame, target: DataFrame, spec: ReconSpec, *, numeric: set[str] | None = None,
              hot_key_rows: int = P.HOT_KEY_ROWS, hot_keys: list[str] | None = None) -> ReconResult:
    """Compare ``source`` with ``target`` under ``spec``; outputs are lazy.

    Keys with more than ``hot_key_rows`` rows on both sides together take the range path (same
    result, spread over tasks); ``hot_keys`` names them instead.
    """
    prep = prepare(source, target, spec, numeric=numeric)
    al = prep.alignment
    judged = judge(prep.source, prep.target, al.compare, al.order_by, prep.numeric, spec.case_sensitive, hot_key_rows)
    if hot_keys is not None:
        rows = [(k, 0) for k in hot_keys]
        hot = source.sparkSession.createDataFrame(rows, f"{KEY} string, _rows bigint") if rows else None
    else:
        hot = judged.hot()
    return ReconResult(prep, judged, hot)
