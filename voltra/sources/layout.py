"""Places of 32 electrodes of the international 10-20 system and of two ocular channels."""

from __future__ import annotations

from .brainvision import spherical_to_xyz

# Radius, theta and phi (degrees) of each channel; radius 0 has no place.
SPHERICAL_32_1020 = {
    "Fp1": (1, -90, -72), "Fpz": (1, 90, 90), "Fp2": (1, 90, 72), "F7": (1, -90, -36), "F3": (1, -60, -51), "Fz": (1, 45, 90), "F4": (1, 60, 51), "F8": (1, 90, 36),
    "FC5": (1, -69, -21), "FC1": (1, -31, -46), "FC2": (1, 31, 46), "FC6": (1, 69, 21), "M1": (0, 0, 0), "T7": (1, -90, 0), "C3": (1, -45, 0), "Cz": (1, 0, 0), "C4": (1, 45, 0), "T8": (1, 90, 0), "M2": (0, 0, 0),
    "CP5": (1, -69, 21), "CP1": (1, -31, 46), "CP2": (1, 31, -46), "CP6": (1, 69, -21), "P7": (1, -90, 36), "P3": (1, -60, 51), "Pz": (1, 45, -90), "P4": (1, 60, -51), "P8": (1, 90, -36),
    "POz": (1, 67, -90), "O1": (1, -90, 72), "Oz": (1, 90, -90), "O2": (1, 90, -72), "HEOG": (0, 0, 0), "VEOG": (0, 0, 0),
}


def layout_32_1020() -> dict[str, dict]:
    """Channel facts to hand to a recording: radius, theta, phi, _x, _y, _z."""
    return {c: {"radius": r, "theta": t, "phi": p} | dict(zip(("_x", "_y", "_z"), spherical_to_xyz(r, t, p), strict=True)) for c, (r, t, p) in SPHERICAL_32_1020.items()}
