"""orderkeep.plans"""
