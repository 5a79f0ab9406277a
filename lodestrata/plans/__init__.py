"""From a question to a plan: routing, data set choice, rules, the plan algebra."""
