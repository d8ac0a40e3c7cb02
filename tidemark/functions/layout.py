"""State layouts: which component of a state vector means what."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Components of each mode, in order.
COMPONENTS = {
    "vision_only": "x y vx vy yaw",
    "2d_full": "x y vx vy yaw bgz bax bay",
    "imu_only": "x y vx vy yaw bgz bax bay",
    "2d_cam_3d_imu": "x y vx vy vz yaw bgz bax bay baz",
    "2d_cam_6dof_imu_orientation": "x y vx vy qw qx qy qz bgx bgy bgz bax bay baz",
    "3d_euler": "x y z vx vy vz roll pitch yaw bgx bgy bgz bax bay baz",
    "3d_quat": "x y z vx vy vz qw qx qy qz bgx bgy bgz bax bay baz",
    "3d_cam_6dof_imu": "x y z vx vy vz qw qx qy qz bgx bgy bgz bax bay baz",
}

_GROUPS = {"position": ("x", "y", "z"), "velocity": ("vx", "vy", "vz"), "heading": ("roll", "pitch", "yaw", "qw", "qx", "qy", "qz"), "gyro_bias": ("bgx", "bgy", "bgz"), "accel_bias": ("bax", "bay", "baz")}


@dataclass(frozen=True)
class StateLayout:
    """Named components, each once; the groups below are their places."""

    names: tuple[str, ...]
    position: tuple[int, ...] = field(init=False)
    velocity: tuple[int, ...] = field(init=False)
    heading: tuple[int, ...] = field(init=False)
    gyro_bias: tuple[int, ...] = field(init=False)
    accel_bias: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        known = {n for group in _GROUPS.values() for n in group}
        if not self.names or len(set(self.names)) != len(self.names) or not set(self.names) <= known:
            raise ValueError(f"components must be known and each occur once: {self.names}")
        for group, members in _GROUPS.items():
            object.__setattr__(self, group, tuple(i for i, n in enumerate(self.names) if n in members))
        if len(self.heading) not in (1, 3, 4):
            raise ValueError("the heading has 1 component (yaw), 3 (Euler angles) or 4 (quaternion)")

    @property
    def n(self) -> int:
        return len(self.names)

    @property
    def has_biases(self) -> bool:
        return bool(self.gyro_bias or self.accel_bias)

    @property
    def spatial_dim(self) -> int:
        return len(self.position)

    @property
    def has_heading_2d(self) -> bool:
        return len(self.heading) == 1

    @property
    def has_orientation_3d(self) -> bool:
        return len(self.heading) > 1

    @property
    def is_quaternion(self) -> bool:
        return len(self.heading) == 4

    @property
    def heading_index(self) -> int:
        if not self.has_heading_2d:
            raise NotImplementedError("the heading of this layout isn't one component")
        return self.heading[0]


LAYOUTS = {mode: StateLayout(tuple(names.split())) for mode, names in COMPONENTS.items()}


def get_layout(mode: str) -> StateLayout:
    """The layout of a mode; KeyError if there is none."""
    return LAYOUTS[mode]
