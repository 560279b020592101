"""Settings of a run: sampling, distribution, cache and model, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

# What the settings may name, widths of cached rows, bytes a component, ways of a cache set.
DISTRIBUTIONS = ("node_color", "baseline")
BACKENDS = ("nvshmem", "nccl", "isolated")
MODELS = ("sage", "gat", "gcn")
CACHE_DIMS = (128, 256, 512, 1024)
COMPONENT_BYTES, WAYS = 4, 32
#: Rate of seeds, levels and neighbours of the coloring.
SEED_RATE, LEVELS, TOP = 0.005, 10, 10


def parse_fanout(text: str) -> list[int]:
    """``"10,5,5"`` -> [10, 5, 5]; anything but positive numbers between commas raises ValueError."""
    try:
        out = [int(x) for x in text.split(",")]
    except ValueError:
        raise ValueError(f"fan-out must be numbers between commas, not {text!r}") from None
    if min(out) < 1:
        raise ValueError(f"fan-outs must be positive: {text!r}")
    return out


def sampled_bound(batch: int, fanouts: list[int]) -> int:
    """Most input nodes of a batch: every layer adds at most its fan-out for each node so far."""
    n = batch
    for f in reversed(fanouts):
        n *= f + 1
    return n


def cache_dim(dim: int) -> int:
    """The narrowest cached row that holds ``dim`` components; wider features raise ValueError."""
    for width in CACHE_DIMS:
        if 0 < dim <= width:
            return width
    raise ValueError(f"features of {dim} components can't be cached (1 to {CACHE_DIMS[-1]})")


@dataclass(frozen=True)
class Geometry:
    """Pages, and sets of ``ways`` lines, of a cache of so many MB for features of ``dim`` components."""

    cache_mb: int
    dim: int
    ways: int = WAYS

    @property
    def page_bytes(self) -> int:
        return COMPONENT_BYTES * cache_dim(self.dim)

    @property
    def lines(self) -> int:
        return self.cache_mb * 2**20 // self.page_bytes

    @property
    def sets(self) -> int:
        return self.lines // self.ways


@dataclass(frozen=True)
class Settings:
    """All parameters of a run; names that aren't known and sizes that can't be raise ValueError."""

    fan_out: str = "10,5,5"
    batch_size: int = 1024
    gpus: int = 4
    machines: int = 4
    cache_size: int = 4096
    distribution: str = "node_color"
    cache_backend: str = "nvshmem"
    refresh_counter: int = 10
    model: str = "sage"
    epochs: int = 3
    num_layers: int = 3
    hidden_channels: int = 128
    num_heads: int = 4
    learning_rate: float = 0.01
    decay: float = 0.001
    dropout: float = 0.2
    top: int = TOP
    fanouts: list[int] = field(init=False)

    def __post_init__(self):
        for name, known in (("distribution", DISTRIBUTIONS), ("cache_backend", BACKENDS), ("model", MODELS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {getattr(self, name)!r}")
        for name in ("batch_size", "gpus", "machines", "cache_size", "refresh_counter", "epochs", "num_layers", "hidden_channels", "num_heads", "top"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.hidden_channels % self.num_heads:
            raise ValueError("hidden_channels must be a multiple of num_heads")
        object.__setattr__(self, "fanouts", parse_fanout(self.fan_out))
        if len(self.fanouts) != self.num_layers:
            raise ValueError(f"{self.num_layers} layers need as many fan-outs, not {self.fan_out!r}")

    @property
    def domain_batch(self) -> int:
        return self.batch_size * self.gpus

    @property
    def global_batch(self) -> int:
        return self.domain_batch * self.machines

    @property
    def most_sampled(self) -> int:
        return sampled_bound(self.batch_size, self.fanouts)
