"""From text to plans: tokens, syntax tree, planner."""
