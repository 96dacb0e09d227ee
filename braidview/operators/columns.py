"""Choosing, renaming and deriving columns by the patterns in their names; names are settled at the driver from the schema alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _some(x: str | Iterable[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def match_positions(patterns: str | Iterable[str], names: Sequence[str], every: bool = False) -> list[int]:
    """Places (from 0) of the names that match any pattern, or every one."""
    tests = [re.compile(p) for p in _some(patterns)]
    test = all if every else any
    return [i for i, n in enumerate(names) if tests and test(t.search(n) for t in tests)]


def matching(column: Column | str, patterns: str | Iterable[str], every: bool = False, exclude: Iterable[str] | str | None = None) -> Column:
    """The same rule for values of a string column."""
    column = F.col(column) if isinstance(column, str) else column
    tests = [column.rlike(p) for p in _some(patterns)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if every else out | t
    for p in _some(exclude):
        out = out & ~column.rlike(p)
    return out


def names_of_any(patterns: str | Iterable[str], columns: Sequence[str], exclude: Iterable[str] | str | None = None) -> list[str]:
    """Names that match any pattern and no exclusion, in alphabetical order."""
    drop = _some(exclude)
    return sorted(columns[i] for i in match_positions(patterns, columns) if not any(re.search(p, columns[i]) for p in drop))


def names_of_all(patterns: str | Iterable[str], columns: Sequence[str], exclude: Iterable[str] | str | None = None) -> list[str]:
    """Names that match every pattern and no exclusion, in the order of the columns."""
    drop = _some(exclude)
    return [columns[i] for i in match_positions(patterns, columns, every=True) if not any(re.search(p, columns[i]) for p in drop)]


# The imaging predictor program. What the groups ask for, and what they leave out besides the common list.
COMMON_OUT = [
    "hier_id", "background", "SNR", "evr", "mask", "msk", "smoothing", "minutes", "RandBasis", "templateL1", "upsampl", "paramset", "nc_wm", "nc_csf", "censor",
    "bandpass", "outlier", "meanBold", "dimensionality", "spc", "org", "andwidth", "unclassified", "cleanup", "slice", "dimx", "dimy", "dimz", "dimt", "modality",
]
FUNCTIONAL_OUT = [
    "hier_id", "background", "thk", "area", "vol", "FD", "dvars", "ssnr", "tsnr", "motion", "SNR", "evr", "_alff", "falff_sd", "falff_mean",
]
GROUPS: list[tuple[str, list[str]]] = [
    ("T1w_", []),
    ("mtl", []),
    ("cerebellum", ["_cerebell"]),
    ("T1Hier_", ["hier_id", r"[.]1", r"[.]2", r"[.]3", "background", "tissue", "dktregions", "T1Hier_resnetGrade", "hemisphere", "lobes", "SNR", "evr", "area"]),
    ("", []),  # the brainstem volumes
    ("rsfMRI_fcnxpro", FUNCTIONAL_OUT),
    ("perf_", FUNCTIONAL_OUT),
    ("DTI_", ["hier_id", "background", "thk", "area", "vol", "motion", "FD", "dvars", "ssnr", "tsnr", "SNR", "evr", "cnx", "relcn"]),
]


def imaging_predictors(columns: Sequence[str], asymmetry: bool = False) -> list[str]:
    """The predictor columns of an imaging table, each once; the first brainstem volume is left out."""
    out = COMMON_OUT + [n for n in names_of_all("bn_str_ca", columns) if "deep" not in n]
    if asymmetry:
        out = [*out, "left", "right", "_l_", "_r_"]
    picked: list[str] = []
    for want, less in GROUPS:
        picked += names_of_all(want, columns, [*less, *out]) if want else names_of_all(["T1Hier", "brainstem", "vol"], columns, ["tissues", "lobes"])[1:]
    return list(dict.fromkeys(picked))


def lower_sides(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("Right", "right").replace("Left", "left") for c in df.columns])


def _sided(df: DataFrame, left_columns: Iterable[str], left: str, right: str, tag: str, rule) -> DataFrame:
    there, made = set(df.columns), {}
    for name in left_columns:
        twin = name.replace(left, right)
        if name in there and twin in there and twin != name:
            made[name.replace(left, tag)] = rule(F.col(f"`{name}`"), F.col(f"`{twin}`"))
    return df.withColumns(made) if made else df


def add_asymmetry(df: DataFrame, left_columns: Iterable[str], left: str = "left", right: str = "right", tag: str = "Asym") -> DataFrame:
    """For each left column with a right twin |left - right|."""
    return _sided(df, left_columns, left, right, tag, lambda a, b: F.abs(a - b))


def add_side_average(df: DataFrame, left_columns: Iterable[str], left: str = "left", right: str = "right", tag: str = "LRAVG") -> DataFrame:
    """For each left column with a right twin their mean."""
    return _sided(df, left_columns, left, right, tag, lambda a, b: 0.5 * (a + b))


def imaging_table(df: DataFrame, asymmetry: bool = False) -> DataFrame:
    """The table with sides in lower case and the predictors' side averages (and asymmetries)."""
    names = [n.replace("Right", "right").replace("Left", "left") for n in imaging_predictors(df.columns, False)]
    df = lower_sides(df)
    for left, right in (("_l_", "_r_"), ("left", "right")):
        own = [n for n in names if left in n]
        df = add_asymmetry(df, own, left, right) if asymmetry else df
        df = add_side_average(df, own, left, right)
    return df


#: Which substrings put a column into which view.
VIEW_MARKS = {"t1": ("T1Hier",), "dt": ("DTI", "mean_fa", "mean_md"), "rsf": ("rsfMRI",), "perf": ("perf_cbf",)}


def assemble_views(names: Sequence[str], marks: Mapping[str, Sequence[str]] = VIEW_MARKS) -> dict[str, list[str]]:
    """Views by substrings of their columns' names; empty ones are left out."""
    views = {v: [n for n in names if any(m in n for m in ms)] for v, ms in marks.items()}
    return {v: ns for v, ns in views.items() if ns}


def quality_rows(df: DataFrame, grade: str, least: float, mask: Column | None = None, fewest: int = 5) -> DataFrame:
    """Rows graded ``least`` or more (NaN isn't) that the mask admits; fewer than ``fewest`` are an error."""
    ok = F.col(f"`{grade}`").isNotNull() & ~F.isnan(F.col(f"`{grade}`").cast("double")) & (F.col(f"`{grade}`") >= least)
    out = df.where(ok if mask is None else ok & mask)
    if out.limit(fewest).count() < fewest:
        raise ValueError(f"fewer than {fewest} rows pass the quality filter")
    return out


# Replacements that shorten imaging column names, in this order; None collapses runs of dots.
SHORTER: list[tuple[str, str] | None] = [
    None,
    ("sagittal.stratum.include.inferior.longitidinal.fasciculus.and.inferior.fronto.occipital.fasciculus.", "ilf.and.ifo"),
    (".cres.stria.terminalis.can.not.be.resolved.with.current.resolution.", ""),
    ("longitudinal.fasciculus", "l.fasc"),
    ("corona.radiata", "cor.rad"),
    ("central", "cent"),
    ("deep.cit168", "dp."),
    ("cit168", ""),
    (".include", ""),
    ("mtg.sn", ""),
    ("brainstem", ".bst"),
    ("rsfmri.", "rsf."),
    ("dti.mean.fa.", "dti.fa."),
    ("perf.cbf.mean.", "cbf."),
    (".jhu.icbm.labels.1mm", ""),
    (".include.optic.radiation.", ""),
    None,
    ("cerebellar.peduncle", "cereb.ped"),
    ("anterior.limb.of.internal.capsule", "ant.int.cap"),
    ("posterior.limb.of.internal.capsule", "post.int.cap"),
    ("t1hier.", "t1."),
    ("anterior", "ant"),
    ("posterior", "post"),
    ("inferior", "inf"),
    ("superior", "sup"),
    ("dktcortex", ".ctx"),
    (".lravg", ""),
    ("dti.mean.fa", "dti.fa"),
    ("retrolenticular.part.of.internal", "rent.int.cap"),
    ("iculus.could.be.a.part.of.ant.internal.capsule", ""),
    (".fronto.occipital.", ".frnt.occ."),
    (".longitidinal.fasciculus.", ".long.fasc."),
    (".external.capsule", ".ext.cap"),
    ("of.internal.capsule", ".int.cap"),
    ("fornix.cres.stria.terminalis", "fornix."),
    ("capsule", ""),
    ("and.inf.frnt.occ.fasciculus.", ""),
    ("crossing.tract.a.part.of.mcp.", ""),
    ("post.thalamic.radiation.optic.radiation", "post.thalamic.radiation"),
    ("adjusted", "adj"),
    None,
    ("t1w.mean", "t1vth"),
    ("fcnxpro129", "p2"),
    ("fcnxpro134", "p3"),
    ("fcnxpro122", "p1"),
    ("nm2dmt.nm.", "nm."),
    (".avg.", ".iavg."),
    ("intmean", "iavg"),
    ("intsum", "isum"),
    ("volume", "vol"),
    ("substantianigra", "sn"),
]


def shorten(column: Column) -> Column:
    """The shortening program as a column expression."""
    out = F.translate(F.lower(column), "_", ".")
    for step in SHORTER:
        out = F.regexp_replace(out, r"\.{2,}", ".") if step is None else F.replace(out, F.lit(step[0]), F.lit(step[1]))
    return out


def shorten_name(name: str) -> str:
    out = name.lower().replace("_", ".")
    for step in SHORTER:
        out = re.sub(r"\.{2,}", ".", out) if step is None else out.replace(*step)
    return out


def versioned(name: str, used: set[str], prefix: str = "r") -> str:
    """``name``, or if it is taken a version of it: a tag such as r00.1 stands before its last digits."""
    head, digits = re.fullmatch(r"(.*?)(\d*)", name, re.S).groups()
    for k in range(1_000_000):
        tried = name if not k else f"{head}{prefix}{(k - 1) // 9:02d}.{(k - 1) % 9 + 1}{digits}"
        if tried not in used:
            return tried
    raise ValueError(f"no free version of {name}")


def apply_bases(
    df: DataFrame, bases: Mapping[str, np.ndarray], features: Mapping[str, Sequence[str]], components: Mapping[str, Sequence[str]] | None = None,
    limit: int | None = None, prefix: str = "r",
) -> tuple[DataFrame, list[str]]:
    """Append the scores of each block: cleaned features times the block's basis, over the features that the table has.

    Blocks without any are left out. Scores are named <block>_<component>, with a version if that is taken; a later block may use them as features.
    Plain column arithmetic, map-only.
    """
    added: list[str] = []
    for block, basis in bases.items():
        basis = np.asarray(basis, dtype=float)
        names = list((components or {}).get(block) or [f"PC{j + 1}" for j in range(basis.shape[1])])[: limit or basis.shape[1]]
        rows = [i for i, f in enumerate(features[block]) if f in set(df.columns)]
        if not rows:
            continue
        used, made = set(df.columns), {}
        for j, c in enumerate(names):
            c = c.removeprefix(block).removeprefix("_")
            name = versioned(f"{block}_{c}", used, prefix)
            used.add(name)
            made[name] = weighted_sum([features[block][i] for i in rows], basis[rows, j])
        df = df.withColumns(made)
        added += made
    return df, added


def apply_bases_shortened(df: DataFrame, bases: Mapping[str, np.ndarray], features: Mapping[str, Sequence[str]], **options) -> tuple[DataFrame, list[str]]:
    """As :func:`apply_bases`; if more features are found by their shortened names, both sides are shortened for the while and the table's names come back after."""
    own, short = list(df.columns), [shorten_name(c) for c in df.columns]
    wanted = {b: [shorten_name(f) for f in fs] for b, fs in features.items()}
    plain = sum(f in set(own) for fs in features.values() for f in fs)
    if len(set(short)) < len(short) or sum(f in set(short) for fs in wanted.values() for f in fs) <= plain:
        return apply_bases(df, bases, features, **options)
    out, added = apply_bases(df.toDF(*short), bases, wanted, **options)
    return out.toDF(*own, *added), added


def value(name: str) -> Column:
    """A column as a double with NaN as null."""
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def weighted_sum(names: Sequence[str], weights: Sequence[float]) -> Column:
    """Sum of weight times value with missing values as 0; zero weights are left out of the plan."""
    out = F.lit(0.0)
    for n, w in zip(names, weights):
        if w:
            out = out + F.coalesce(value(n), F.lit(0.0)) * F.lit(float(w))
    return out
