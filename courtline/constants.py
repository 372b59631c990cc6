"""Fixed values of the court, the windows and the labels."""

from __future__ import annotations

COURT_W, COURT_H, NET_Y = 1800.0, 900.0, 450.0
FPS, N_SLOTS, WINDOW = 30, 6, 29
#: Positions outside are missing: (low, high), both inclusive.
ENVELOPE_X, ENVELOPE_Y = (-900.0, 2700.0), (-1800.0, 1800.0)
STEP_CAP = 50.0
LABELS = {"Unclassified": 0, "Coordinated Attack": 1, "Coordinated Defense": 2, "Delayed Support": 3, "Spacing Breakdown": 4}
TACTICS = tuple(k for k, v in LABELS.items() if v)
FRAME_CHANNELS = ("ball_present", "ball_x", "ball_y", "centroid_x", "centroid_y", "spread_x", "spread_y", "hull_area", "nn_dist_mean", "nn_dist_min", "nn_dist_max", "max_pair_dist", "n_present", "ball_to_centroid")
KINEMATIC_CHANNELS = ("speed_top2", "speed_bot4", "speed_diff", "sync_inst")
