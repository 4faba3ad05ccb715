"""The data-quality catalogue: one list of checks, run as one scan for each table."""

from finscope.checks import assets, budgets, contracts, ledger, orders, payables, projects, receivables, staff

CATALOGUE = [*payables.CHECKS, *receivables.CHECKS, *ledger.CHECKS, *orders.CHECKS, *assets.CHECKS, *contracts.CHECKS, *budgets.CHECKS, *projects.CHECKS, *staff.CHECKS]
