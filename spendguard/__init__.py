"""spendguard: spend control over tables, as Spark DataFrame plans.

Price month-to-date usage against an effective-dated price list, compare the total with a
threshold, plan which jobs / runs / clusters / warehouses / apps to stop, record the actions in
an audit table, and plan their resumption from it. Built from Spark's own operators (filters,
semi/anti joins, a size-checked broadcast join, CASE expressions, unions), with no UDFs.

* :mod:`spendguard.plans` - budget check, stop plans, audit table, resume plan
* :mod:`spendguard.tasks` - the three scheduled steps with text parameters
* :mod:`spendguard.streaming` - the budget check run incrementally
* :mod:`spendguard.operators`, :mod:`spendguard.functions` - the building blocks
"""

from spendguard import functions, operators, plans, schemas, sources, streaming, tasks

__all__ = ["functions", "operators", "plans", "schemas", "sources", "streaming", "tasks"]
