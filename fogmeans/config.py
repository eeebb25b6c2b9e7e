"""Protocol constants, as one frozen object instead of process state."""

from dataclasses import dataclass

EPS = 1e-12


@dataclass(frozen=True)
class Protocol:
    """Fixed values of the protocol."""

    server_lr: float = 0.75
    delta_lr: float = 0.7
    delta_reg: float = 0.05
    min_relevance: float = 0.05
    grid: int = 60
    quantile: float = 0.95
    tol: float = 1e-5
    seed_offset: int = 1201
    rounds: int = 50
    local_steps: int = 5
    m: float = 2.0

    def fuzzifier(self, dataset: str) -> float:
        """The fuzzifier of each data set; 2.0 elsewhere."""
        return {"pendigits": 1.5, "digits_pca16": 1.3, "letter": 1.3, "digits_pca32": 1.1, "mnist784_pca32 (20c)": 1.1, "mnist784_pca32 (50c)": 1.1}.get(dataset, 2.0)


#: Names of the configurations, in report order; (clients, labels a client, rows at least) of the real ones.
SYNTHETIC = ("cluster_skew_hard", "cluster_skew_overlap", "dirichlet_0.03", "dirichlet_0.1", "overlap_noise", "quantity_skew_extreme")
REAL = {"wine": (10, 2, 5), "satimage": (10, 3, 5), "pendigits": (10, 3, 5), "digits_pca16": (10, 2, 5), "digits_pca32": (10, 2, 5), "letter": (10, 6, 50), "mnist784_pca32 (20c)": (20, 3, 50), "mnist784_pca32 (50c)": (50, 3, 20)}
CONFIGS = (*SYNTHETIC, *REAL)
MASSES, GATES, PERSONAL = ("post", "pre"), ("none", "footprint", "mass", "fpmask", "massmask"), ("off", "on")
#: Seeds kept for the last confirmatory run.
FRESH = range(20, 30)


def _picked(text: str, known: tuple, groups: dict, what: str) -> list[str]:
    tokens = [t.strip() for t in text.split(",") if t.strip()]
    names = [n for t in tokens for n in groups.get(t.lower(), [t])]
    if wrong := [n for n in names if n not in known]:
        raise ValueError(f"unknown {what} {wrong}; known are {list(known)} and groups {sorted(groups)}")
    return list(dict.fromkeys(names))


def parse_datasets(text: str | None = None) -> list[str]:
    """Names from a comma-separated list with groups; none: all."""
    mnist = [c for c in CONFIGS if c.startswith("mnist")]
    groups = {"all": CONFIGS, "nonmnist": [c for c in CONFIGS if c not in mnist], "real8": list(REAL), "mnist20": mnist[:1], "mnist50": mnist[1:]}
    return _picked(text, CONFIGS, groups, "data set") if text else list(CONFIGS)


def cell_name(mass: str, gate: str, personal: str) -> str:
    return f"{mass}_{gate}_{personal}"


def parse_cells(text: str | None = None) -> list[str]:
    """Cell names from a comma-separated list with groups and the four named methods; none: all sixteen."""
    twelve = [cell_name(m, g, p) for m in MASSES for g in GATES[:3] for p in PERSONAL]
    masks = [cell_name(m, g, "off") for m in MASSES for g in GATES[3:]]
    known = tuple(cell_name(m, g, p) for m in MASSES for g in GATES for p in PERSONAL)
    named = {"post": ["post_none_off"], "pre": ["pre_none_off"], "gate_only": ["post_footprint_off"], "gf": ["post_footprint_on"]}
    groups = {"all12": twelve, "all16": twelve + masks, "masks": masks, **named}
    return _picked(text.lower(), known, groups, "cell") if text else twelve + masks


def checked_seeds(first: int, count: int, fresh: bool = False) -> list[int]:
    """Seeds first .. first + count - 1; the fresh ones are refused unless asked for."""
    seeds = list(range(first, first + count))
    if not fresh and (kept := [s for s in seeds if s in FRESH]):
        raise ValueError(f"seeds {kept} are kept for the confirmatory run")
    return seeds
