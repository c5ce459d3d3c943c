"""Multi-stage plans and the queries registered for the driver."""
