"""Small grids and programs as literals."""

# An own five-bus ring with one chord: bus 4 is the reference, two branches are limited.
RING5 = """function mpc = ring5
%% five towns around a lake
mpc.version = '2';
mpc.baseMVA = 100;
%	bus_i	type	Pd	Qd	Gs
mpc.bus = [
	1	1	60	12	0	0	1	1	0	110	1	1.05	0.95;
	2	2	150	35	0	0	1	1	0	110	1	1.05	0.95;
	3	1	210	44	0	0	1	1	0	110	1	1.05	0.95;
	4	3	90	18	0	0	1	1	0	110	1	1.05	0.95; % the dam ]; here
	5	2	30	6	0	0	1	1	0	110	1	1.05	0.95;
];
mpc.gen = [
	2	50	0	60	-60	1	100	1	120	0;
	1	80	0	60	-60	1	100	1	160	0;
	3	90	0	60	-60	1	100	1	240	0;
	4	70	0	60	-60	1	100	1	300	0;
	5	250	0	60	-60	1	100	1	280	0;
];
mpc.branch = [
	1	2	0.002	0.05	0	180	180	180	0	0	1	-360	360;
	2	3	0.002	0.04	0	0	0	0	0	0	1	-360	360;
	3	4	0.002	0.08	0	0	0	0	0	0	1	-360	360;
	4	5	0.002	0.02	0	320	320	320	0	0	1	-360	360;
	5	1	0.002	0.10	0	0	0	0	0	0	1	-360	360;
	2	5	0.002	0.06	0	0	0	0	0	0	1	-360	360;
];
mpc.gencost = [
	2	0	0	2	22	0;
	2	0	0	2	18	0;
	2	0	0	2	35	0;
	2	0	0	2	27	0;
	2	0	0	2	12	0;
];
"""


def _config(name, periods, **more):
    """An operating configuration; the field names are the format's."""
    return {
        "name": name,
        "classification": f"{periods} hours of the lake towns",
        "synthetic_extension": bool(more),
        "periods": periods,
        "interval_hours": 1.0,
        "load_multipliers": [0.75, 1.0][-periods:],
        "reserve_up_mw": [16.0 * (i + 1) if more else 0.0 for i in range(periods)],
        "reserve_down_mw": [12.0 * (i + 1) if more else 0.0 for i in range(periods)],
        "generator_ramp_up_mw_per_hour": [14.0 if more else 0.0] * 5,
        "generator_ramp_down_mw_per_hour": [14.0 if more else 0.0] * 5,
        "renewables": [],
        "storage": [],
        **more,
    }


BASE_CONFIG = _config("plain hour", 1)
TWO_PERIODS = _config(
    "two hours with wind",
    2,
    renewable_penalty_per_mwh=35.0,
    storage_loss_penalty_per_mwh=4.0,
    renewables=[{"id": "wind_3", "bus_id": 3, "minimum_mw": [0.0, 0.0], "maximum_mw": [45.0, 70.0]}],
    storage=[
        {
            "id": "pond_1",
            "bus_id": 1,
            "initial_energy_mwh": 60.0,
            "minimum_energy_mwh": 20.0,
            "maximum_energy_mwh": 90.0,
            "maximum_charge_mw": 30.0,
            "maximum_discharge_mw": 35.0,
            "charge_efficiency": 0.9,
            "discharge_efficiency": 0.8,
        }
    ],
)

A = "case_id long, block string, row long, col long, value double"
ROW_VEC = "case_id long, block string, row long, b double"
COL_VEC = "case_id long, col long, c double, lower double, upper double"
STATE_COL = "case_id long, col long, x double, z double"
STATE_ROW = "case_id long, block string, row long, y double"
BRANCH = (
    "case_id long, branch_id long, from_bus long, to_bus long, reactance double, tap double, "
    "shift_degrees double, rate_mw double, status boolean"
)

# Minimise c'x with A1 x = b1, A2 x >= b2 inside a box, each made from a chosen point and chosen
# multipliers: c = A1'y1 + A2'y2 + z.  Order: c, A1, b1, A2, b2, lower, upper, x, y, z, objective.
PROGRAMS = {
    # w rests at 0, v + w >= 1 binds, u - w >= -2 does not: 2 u + v = 4 gives (3/2, 1, 0)
    1: (
        [2, 1.5, 2], [[2, 1, 1]], [4], [[0, 1, 1], [1, 0, -1]], [1, -2], [0, 0, 0], [4, 4, 4],
        [1.5, 1, 0], [1, 0.5, 0], [0, 0, 0.5], 4.5,
    ),
    # two orthogonal equalities and a binding inequality settle all three variables inside the box
    2: (
        [2, 3.5, 4.5], [[1, 2, 0], [2, -1, 5]], [7, 9], [[0, 1, 1]], [3], [0, 0, 0], [5, 5, 5],
        [3, 2, 1], [1, 0.5, 2], [0, 0, 0], 17.5,
    ),
    # four variables: the first ends at its upper bound, the last at a negative lower bound
    3: (
        [-2, -3, -2, 1], [[1, 3, 2, 0]], [5], [[0, 1, 0, -1], [1, 0, 0, 0.5]], [2.5, 0],
        [0, 0, -1, -2], [1, 4, 3, 2], [1, 1, 0.5, -2], [-1, 0, 0.25], [-1.25, 0, 0, 0.875], -8,
    ),
}


def program_tables(table, x=None):
    """The three programs as one batch of tables, with their known solutions."""
    a, rows, cols, sc, sr = [], [], [], [], []
    for case, (c, a1, b1, a2, b2, low, high, sol, y, z, _) in PROGRAMS.items():
        for block, matrix, rhs, first in (("A1", a1, b1, 0), ("A2", a2, b2, len(b1))):
            for i, line in enumerate(matrix):
                rows.append((case, block, i, float(rhs[i])))
                sr.append((case, block, i, float(y[first + i])))
                a += [(case, block, i, j, float(v)) for j, v in enumerate(line) if v]
        for j, cost in enumerate(c):
            cols.append((case, j, float(cost), float(low[j]), float(high[j])))
            value = (x or {}).get(case, sol)[j]
            sc.append((case, j, float(value), float(z[j])))
    return (
        table(A, a),
        table(ROW_VEC, rows),
        table(COL_VEC, cols),
        table(STATE_COL, sc),
        table(STATE_ROW, sr),
    )
