"""Settings of a clustering run: a frozen record, read from arguments and an optional file."""

from __future__ import annotations

import argparse
import hashlib
import os
from dataclasses import asdict, dataclass

LINKAGES = ("single", "complete", "average")
SCALINGS = ("off", "root", "log", "rank")


@dataclass(frozen=True)
class Settings:
    """Names and defaults are those users of the command line know.

    exempt_last_block: leave the last block of each charge whole, however large.
    parts: write results as folders of parts, by all tasks, and not as single files.
    """

    input_filenames: tuple[str, ...] = ()
    output_filename: str = "clusters"
    work_dir: str | None = None
    overwrite: bool = False
    export_representatives: bool = False
    precursor_tol: tuple[float, str] = (20.0, "ppm")
    rt_tol: float | None = None
    fragment_tol: float = 0.05
    linkage: str = "complete"
    distance_threshold: float = 0.1
    min_matched_peaks: int = 0
    batch_size: int = 2**15
    min_peaks: int = 5
    min_mz_range: float = 250.0
    min_mz: float = 101.0
    max_mz: float = 1500.0
    remove_precursor_tol: float | None = 1.5
    min_intensity: float | None = 0.01
    max_peaks_used: int | None = 50
    scaling: str = "off"
    exempt_last_block: bool = False
    parts: bool = False

    def __post_init__(self) -> None:
        if self.linkage not in LINKAGES:
            raise ValueError(f"linkage must be one of {LINKAGES}")
        if self.scaling not in SCALINGS:
            raise ValueError(f"scaling must be one of {SCALINGS}")
        if self.precursor_tol[1] not in ("ppm", "Da"):
            raise ValueError("the unit of precursor_tol must be ppm or Da")
        if self.batch_size < 2:
            raise ValueError("batch_size must be 2 at least")

    def __getitem__(self, name: str):
        try:
            return getattr(self, name)
        except AttributeError:
            raise KeyError(name) from None

    def staging_key(self, files: list[tuple[str, int, int]]) -> str:
        """A digest of all that decides what the staged spectra are. files: path, length and time of change of each that is read."""
        names = ("min_peaks", "min_mz_range", "min_mz", "max_mz", "fragment_tol", "remove_precursor_tol", "min_intensity", "max_peaks_used", "scaling")
        return hashlib.sha256(repr([sorted(files), *[(n, self[n]) for n in names]]).encode()).hexdigest()[:16]


def parser() -> argparse.ArgumentParser:
    d = Settings()
    p = argparse.ArgumentParser(prog="ionweave", description="Clustering of tandem mass spectra on Spark.\nSettings may also stand in a file (name = value), by default config.ini.", formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-c", "--config", help="settings file")
    p.add_argument("input_filenames", nargs="+", help="peak files (.mgf, .mzML, .mzXML); patterns are expanded")
    p.add_argument("output_filename", help="stem of the output files")
    p.add_argument("--work_dir", default=d.work_dir, help="folder of staged spectra (default: a temporary one)")
    p.add_argument("--overwrite", action="store_true", help="replace existing results")
    p.add_argument("--parts", action="store_true", help="write folders of parts, by all tasks, and not single files")
    p.add_argument("--export_representatives", action="store_true", help="write cluster representatives to an MGF file")
    p.add_argument("--precursor_tol", nargs=2, default=list(d.precursor_tol), help="precursor tolerance and its unit, ppm or Da")
    p.add_argument("--linkage", default=d.linkage, choices=LINKAGES)
    p.add_argument("--scaling", default=d.scaling, choices=SCALINGS)
    p.add_argument("--rt_tol", type=float, default=d.rt_tol, help="retention time tolerance (default: none)")
    for name, kind in (("fragment_tol", float), ("distance_threshold", float), ("min_matched_peaks", int), ("batch_size", int), ("min_peaks", int), ("min_mz_range", float), ("min_mz", float), ("max_mz", float), ("remove_precursor_tol", float), ("min_intensity", float), ("max_peaks_used", int)):
        p.add_argument(f"--{name}", type=kind, default=d[name], help="default: %(default)s")
    return p


def _from_file(path: str) -> list[str]:
    """Arguments from lines like ``name = value``; sections and comments are passed over."""
    out: list[str] = []
    for line in open(path, encoding="utf-8"):
        line = line.strip()
        if not line or line[0] in "#;[":
            continue
        name, _, value = line.partition("=") if "=" in line else line.partition(":")
        name, value = name.strip().lstrip("-"), value.strip()
        if value.lower() in ("true", "yes", ""):
            out.append(f"--{name}")
        elif value.lower() not in ("false", "no", "none"):
            out += [f"--{name}", *value.strip("[]").replace(",", " ").replace('"', "").replace("'", "").split()]
    return out


def parse(args: list[str] | str | None = None) -> Settings:
    """Settings from arguments, which win over those of the settings file."""
    import shlex
    import sys

    args = sys.argv[1:] if args is None else shlex.split(args) if isinstance(args, str) else list(args)
    p = parser()
    given = next((args[i + 1] for i, a in enumerate(args[:-1]) if a in ("-c", "--config")), None)
    path = given or ("config.ini" if os.path.isfile("config.ini") else None)
    values = vars(p.parse_args(args))
    if path:
        base = vars(p.parse_args(["-c", path, "in", "out", *_from_file(path)]))
        default = vars(p.parse_args(["in", "out"]))
        said = {a[2:].split("=")[0] for a in args if a.startswith("--")}
        values |= {k: v for k, v in base.items() if k not in ("input_filenames", "output_filename", "config") and k not in said and v != default[k]}
    values.pop("config")
    values["precursor_tol"] = (float(values["precursor_tol"][0]), values["precursor_tol"][1])
    values["input_filenames"] = tuple(values["input_filenames"])
    return Settings(**values)


def described(s: Settings) -> list[str]:
    """One line for each setting, as the header of result files has them."""
    shown = {k: v for k, v in asdict(s).items() if k not in ("input_filenames", "output_filename", "exempt_last_block", "parts")}
    two, three = ("fragment_tol", "min_mz_range", "min_mz", "max_mz", "remove_precursor_tol", "min_intensity"), ("distance_threshold",)
    out = []
    for k, v in shown.items():
        if k == "precursor_tol":
            v = f"{v[0]:.2f} {v[1]}"
        elif v is not None and k in two + three:
            v = f"{v:.{3 if k in three else 2}f}"
        out.append(f"{k} = {v}")
    return out
