"""Where versions come from and go to: stores, loaders, derived histories."""
