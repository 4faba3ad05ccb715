"""Business positions: aged balances, orders, net book value, projects, contracts, budgets, staff."""
