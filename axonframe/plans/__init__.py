"""Plans that need more than one expression: what a run is made of, chosen before it starts."""
