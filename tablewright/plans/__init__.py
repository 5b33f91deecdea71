"""Data-preparation plans: actions, transforms, fitness and search."""
