"""Operators: functions from DataFrames to DataFrames, keyed by ``case_id``.

Matrix tables are ``a(case_id, block, row, col, value)`` with block 'A1' for equalities
and 'A2' for inequalities; vectors are ``row_vec(case_id, block, row, b)``,
``col_vec(case_id, col, c, lower, upper)``, ``state_col(case_id, col, x, z)`` and
``state_row(case_id, block, row, y)``.
"""
