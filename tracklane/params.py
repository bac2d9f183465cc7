"""Parameters of the movement operators. Times are milliseconds, lengths metres, speeds m/s."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The default roster, areas and thresholds that results depend on.
TEAMS = ("A", "B")
BALL = "BALL"
ROSTER_TEXT = (
    "{A1:A},{A2:A},{A3:A},{A4:A},{A5:A},{A6:A},{A7:A},{A8:A},{A9:A},{A10:A},{A11:A},"
    "{B1:B},{B2:B},{B3:B},{B4:B},{B5:B},{B6:B},{B7:B},{B8:B},{B9:B},{B10:B},{B11:B}"
)
THIRDS = ("leftThird", "centerThird", "rightThird")
CORNERS = ("leftBottomCorner", "rightBottomCorner", "leftTopCorner", "rightTopCorner")
GOALS = ("leftGoal", "rightGoal")
BESIDE_GOALS = (
    "slightlyAboveLeftGoal", "slightlyBelowLeftGoal", "slightlyAboveRightGoal", "slightlyBelowRightGoal",
)
OUTSIDE_AREAS = (
    "aboveLeftThird", "aboveCenterThird", "aboveRightThird",
    "belowLeftThird", "belowCenterThird", "belowRightThird",
    "aboveLeftGoal", "slightlyAboveLeftGoal", "leftGoal", "slightlyBelowLeftGoal", "belowLeftGoal",
    "aboveRightGoal", "slightlyAboveRightGoal", "rightGoal", "slightlyBelowRightGoal", "belowRightGoal",
)
HEATMAP_INTERVALS = (0, 1200, 600, 300, 60, 10)
SPEED_LEVELS = (0.277, 3.055, 3.888, 4.722, 6.666)

# Field of the sample matches: 105 x 68, goal mouth |y| <= 3.66, band beside it up to 9, 20 m surroundings.
FIELD_LENGTH = 105.0
FIELD_WIDTH = 68.0
AREAS_TEXT = ",".join((
    "{field:-52.5@52.5@-34@34}",
    "{leftThird:-52.5@-17.5@-34@34}",
    "{centerThird:-17.5@17.5@-34@34}",
    "{rightThird:17.5@52.5@-34@34}",
    "{leftPenaltyBox:-52.5@-36@-20.16@20.16}",
    "{rightPenaltyBox:36@52.5@-20.16@20.16}",
    "{leftBottomCorner:-52.5@-50.5@-34@-32}",
    "{rightBottomCorner:50.5@52.5@-34@-32}",
    "{leftTopCorner:-52.5@-50.5@32@34}",
    "{rightTopCorner:50.5@52.5@32@34}",
    "{aboveLeftThird:-52.5@-17.5@34@54}",
    "{aboveCenterThird:-17.5@17.5@34@54}",
    "{aboveRightThird:17.5@52.5@34@54}",
    "{belowLeftThird:-52.5@-17.5@-54@-34}",
    "{belowCenterThird:-17.5@17.5@-54@-34}",
    "{belowRightThird:17.5@52.5@-54@-34}",
    "{aboveLeftGoal:-72.5@-52.5@9@54}",
    "{slightlyAboveLeftGoal:-72.5@-52.5@3.66@9}",
    "{leftGoal:-72.5@-52.5@-3.66@3.66}",
    "{slightlyBelowLeftGoal:-72.5@-52.5@-9@-3.66}",
    "{belowLeftGoal:-72.5@-52.5@-54@-9}",
    "{aboveRightGoal:52.5@72.5@9@54}",
    "{slightlyAboveRightGoal:52.5@72.5@3.66@9}",
    "{rightGoal:52.5@72.5@-3.66@3.66}",
    "{slightlyBelowRightGoal:52.5@72.5@-9@-3.66}",
    "{belowRightGoal:52.5@72.5@-54@-9}",
))


@dataclass(frozen=True)
class Params:
    """Thresholds of every operator; `with_` returns a changed copy (the later setting wins)."""

    roster_text: str = ROSTER_TEXT
    teams: tuple[str, str] = TEAMS
    ball: str = BALL
    chunk_ms: int = 60_000
    active_threshold_ms: int = 10_000
    position_scale: float = 1.0
    velocity_scale: float = 1000.0
    kickoff_ball_dist: float = 3.0
    kickoff_player_dist: float = 5.0
    kickoff_midline_dist: float = 5.0
    kickoff_gap_ms: int = 60_000
    kickoff_history: int | None = None  # None: all
    hit_speed_diff: float = 2.0
    hit_max_speed: float = 10.0
    hit_angle: float = 0.5
    possession_dist: float = 1.5
    duel_dist: float = 3.0
    possession_tick_ms: int = 1000
    pressing_tick_ms: int = 200
    pressing_min: float = 2.0
    kick_dist: float = 2.25
    ball_back_dist: float = 1.5
    pass_max_ms: int = 7000
    sideways_angle: float = 0.7854
    goal_height: float = 2.44
    pass_history: int | None = None  # None: all
    pass_gap_ms: int = 10_000
    set_play_gap_ms: int = 3000
    set_play_dist: float = 3.0
    set_play_static: float = 1.0
    set_play_moving: float = 4.0
    set_play_history: int = 45
    throw_in_ms: int = 100
    speed_levels: tuple[float, ...] = SPEED_LEVELS
    dribble_speed: float = 1.944
    dribble_ms: int = 1000
    distance_tick_ms: int = 3000
    area_epsilon: float = 0.00001
    grid_x: int = 50
    grid_y: int = 30
    intervals_s: tuple[int, ...] = HEATMAP_INTERVALS
    quirks: bool = False

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def roster(self) -> tuple[tuple[str, str], ...]:
        """(player, team) pairs of the roster text."""
        return tuple(tuple(e.strip("{}").split(":")) for e in self.roster_text.split(","))

    @property
    def items(self) -> tuple[str, ...]:
        """Statistics items: every player, then every team."""
        return tuple(p for p, _ in self.roster) + self.teams
