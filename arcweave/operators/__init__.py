"""Network analysis operators on ``Graph``; every name is also found through ``arcweave.plans.registry``."""
