"""Model artifacts: the cache folder, atomic fetches, NumPy matrices, ONNX sessions."""

from __future__ import annotations

import os
import tempfile
import urllib.request
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: The files of a diarization model.
FILES = ("segmentation.onnx", "embedding.onnx", "plda_transform.npz", "plda_model.npz")


def cache_dir(app: str = "speechframe") -> Path:
    base = os.environ.get("XDG_CACHE_HOME")
    if not base:
        home = os.environ.get("HOME") or os.environ.get("USERPROFILE")
        if not home:
            raise RuntimeError("no home folder is known")
        base = os.path.join(home, ".cache")
    return Path(base, app, "diarization")


def fetch_file(url: str, to: Path) -> Path:
    """Through a temporary file that is renamed, so that a broken download is never taken for the file."""
    to.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(url) as r, tempfile.NamedTemporaryFile(dir=to.parent, delete=False) as f:
        while block := r.read(1 << 16):
            f.write(block)
    os.replace(f.name, to)
    return to


def ensure(base_url: str | None = None, folder: Path | None = None) -> dict[str, Path]:
    """The files by name, fetched where they are missing; without a URL a missing one raises."""
    folder = folder or cache_dir()
    out = {}
    for name in FILES:
        out[name] = folder / name
        if not out[name].exists():
            if not base_url:
                raise FileNotFoundError(out[name])
            fetch_file(f"{base_url.rstrip('/')}/{name}", out[name])
    return out


def as_matrix(a: np.ndarray) -> np.ndarray:
    """float32 in two dimensions; a vector is one row."""
    a = np.atleast_1d(np.asarray(a, np.float32))
    if a.ndim > 2:
        raise ValueError(f"an array of {a.ndim} dimensions")
    return a.reshape(1, -1) if a.ndim == 1 else a


def load_npy(path) -> np.ndarray:
    return as_matrix(np.load(path))


def load_npz(path) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: as_matrix(z[k]) for k in z.files}


def _pick(arrays: dict[str, np.ndarray], *names: str) -> list[np.ndarray]:
    lower = {k.lower(): v for k, v in arrays.items()}
    if missing := [n for n in names if n not in lower]:
        raise KeyError(f"missing {', '.join(missing)}")
    return [lower[n] for n in names]


@dataclass(frozen=True)
class ModelBundle:
    mean: np.ndarray
    transform: np.ndarray
    phi: np.ndarray | None = None
    sigma: np.ndarray | None = None
    segmentation: str | None = None
    embedding: str | None = None


def load_models(files: dict[str, Path]) -> ModelBundle:
    """The matrices, and the sessions' paths; executors open the sessions themselves, once per worker."""
    mean, transform = _pick(load_npz(files["plda_transform.npz"]), "mean", "transform")
    phi, sigma = _pick(load_npz(files["plda_model.npz"]), "phi", "sigma")
    return ModelBundle(mean, transform, phi, sigma, str(files["segmentation.onnx"]), str(files["embedding.onnx"]))


def providers(device: str) -> list[str]:
    """Execution providers for 'mps', a CUDA device number, or anything else: the CPU, which also comes last."""
    own = ["CoreMLExecutionProvider"] if device == "mps" else ["CUDAExecutionProvider"] if device.isdigit() else []
    return [*own, "CPUExecutionProvider"]


def onnx_session(path: str, device: str = "cpu"):
    import onnxruntime

    available = set(onnxruntime.get_available_providers())
    return onnxruntime.InferenceSession(path, providers=[p for p in providers(device) if p in available])
