"""skirmish.plans"""
